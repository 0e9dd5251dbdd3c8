"""Column expressions: no shuffles, no actions."""
