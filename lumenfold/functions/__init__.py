"""Column expressions with the numeric rules of the measurements."""
