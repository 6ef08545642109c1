"""Operators: DataFrame to DataFrame, one module per group of the inventory."""
