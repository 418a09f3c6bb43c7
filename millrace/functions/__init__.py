"""Column functions: each takes and returns Columns, so that they compose under Catalyst."""
