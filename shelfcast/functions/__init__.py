"""Column expressions without any plan of their own."""
