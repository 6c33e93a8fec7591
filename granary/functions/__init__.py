"""Column expressions and small distributed helpers shared by the operators."""
