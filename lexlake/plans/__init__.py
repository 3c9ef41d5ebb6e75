"""Queries over the test tables, one or more for each operator family."""
