"""Incremental forms of the preprocessing steps."""
