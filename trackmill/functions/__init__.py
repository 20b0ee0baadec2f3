"""Column expressions: geometry, vectors, parsing."""
