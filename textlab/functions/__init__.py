"""Column expressions: text, keys, scoring."""
