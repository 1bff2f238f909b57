"""Column rules: every function takes columns and returns a column."""
