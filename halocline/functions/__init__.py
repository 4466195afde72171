"""Column expressions: pure functions of columns, no user-defined functions."""
