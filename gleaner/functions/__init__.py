"""Column expressions and small reductions shared by the operators."""
