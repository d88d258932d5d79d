"""Column-level functions and small shared helpers."""
