"""Column-level building blocks (no Python per row)."""
