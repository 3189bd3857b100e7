"""Incremental collection of response files."""
