"""Column expressions and SQL function names."""
