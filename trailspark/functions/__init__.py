"""Column expressions: Column in, Column out, all built-in and independent of the session zone."""
