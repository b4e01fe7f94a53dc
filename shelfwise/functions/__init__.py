"""Column functions: each takes columns (or column names) and returns a column."""
