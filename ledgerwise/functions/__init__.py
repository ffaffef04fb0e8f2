"""Column functions: text, dates, keys and numbers."""
