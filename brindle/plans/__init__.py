"""Logical plans: conditions, expressions and queries as immutable values."""
