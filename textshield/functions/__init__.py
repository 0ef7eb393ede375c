"""Column expressions: spans, patterns, tables of fixed values."""
