"""Relational operators: ids, deduplication, nested data, linking, catalogue building."""
