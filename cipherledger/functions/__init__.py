"""Column expressions and small driver-side helpers shared by the operators."""
