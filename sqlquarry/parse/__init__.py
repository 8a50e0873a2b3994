"""Tolerant parsers of queries and of table definitions."""
