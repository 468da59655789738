"""Functions as Column expressions."""
