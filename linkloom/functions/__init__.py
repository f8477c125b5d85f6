"""Column expressions and DataFrame helpers for URLs, HTML and text."""
