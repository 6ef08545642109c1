"""Tables that must hold exactly these entries for right results.

Nothing in this package computes anything. Each module is a plain table in its
natural order; the operators turn the tables into broadcast dimensions or into
literal expressions.
"""
