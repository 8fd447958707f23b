"""Queries over the standard tables, with the SQL that states the same result."""
