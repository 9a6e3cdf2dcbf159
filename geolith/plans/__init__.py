"""Queries over the sample tables, one or more for each function, with SQL that computes the same by arithmetic."""
