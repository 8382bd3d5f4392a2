"""Column expressions and aggregate helpers shared by the operators."""
