"""Column expressions: no shuffle, no actions."""
