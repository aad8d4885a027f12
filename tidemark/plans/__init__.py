"""Queries over the tables, with the same results in SQL."""
