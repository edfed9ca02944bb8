"""Physical operators: how each part of a logical plan becomes DataFrame operations."""
