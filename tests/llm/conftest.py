"""Shared small tables."""
