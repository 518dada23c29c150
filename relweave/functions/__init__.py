"""Column expressions: text, parsing, vectors, arithmetic."""
