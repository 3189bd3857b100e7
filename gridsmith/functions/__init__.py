"""Column expressions: one cell in, one value out."""
