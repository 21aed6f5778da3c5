"""Queries over the test tables, with their equivalents in SQL."""
