"""Column expressions over difference strings and sequences; all are built-in functions."""
