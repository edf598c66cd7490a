"""Column functions: text, lists and variant access."""
