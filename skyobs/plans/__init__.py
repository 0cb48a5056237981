"""Composed queries and their SQL twins."""
