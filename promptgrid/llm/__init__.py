"""Corpus operators for training-data pipelines.

Nothing outside this subpackage (but the pipeline script at the repository top) imports it.
"""
