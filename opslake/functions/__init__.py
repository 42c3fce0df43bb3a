"""Column expressions: text, scalar and parsing functions."""
