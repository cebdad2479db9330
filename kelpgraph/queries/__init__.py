"""Queries over the test tables, by area."""
