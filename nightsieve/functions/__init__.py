"""Column expressions: keys, text, tone curves, geometry."""
