"""Column expressions and exact distributed statistics."""
