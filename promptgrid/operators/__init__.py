"""Operators on data frames."""
