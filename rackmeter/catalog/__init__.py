"""Queries over the given tables, each with the SQL it is checked against."""
