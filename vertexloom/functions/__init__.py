"""Column expressions and callable functions."""
