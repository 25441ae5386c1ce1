"""Queries over the driver's tables, each with the same query in SQL."""
