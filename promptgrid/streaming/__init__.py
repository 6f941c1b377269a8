"""Streaming front end (an extension: the pipelines' capabilities need none)."""
