"""Column functions: every scalar operator as a Spark expression."""
