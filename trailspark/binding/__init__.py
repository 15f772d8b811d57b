"""The audit model bound to the benchmark tables, its queries and their SQL twins."""
