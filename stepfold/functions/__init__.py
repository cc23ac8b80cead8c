"""Column expressions for bits, value text and names."""
