"""Composed queries over the mapped tables."""
