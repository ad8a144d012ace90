"""Operators bound to the given tables, each next to an equivalent SQL statement."""
