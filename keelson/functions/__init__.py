"""Column expressions and rank helpers shared by the operators."""
