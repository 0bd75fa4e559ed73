"""Column expressions and exact distributed statistics; no Python runs per row."""
