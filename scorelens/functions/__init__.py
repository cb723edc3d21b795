"""Column expressions: no actions, no joins, no shuffles."""
