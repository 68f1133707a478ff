"""Column expressions and array-wise text scanning."""
