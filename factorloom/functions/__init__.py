"""Column and grouped helpers that Spark has no single function for."""
