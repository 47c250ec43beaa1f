"""Column expressions: sequences and numbers."""
