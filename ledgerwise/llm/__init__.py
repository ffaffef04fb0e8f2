"""Operators for preparing training data: deduplication, scoring, mixing, formatting, tokens."""
