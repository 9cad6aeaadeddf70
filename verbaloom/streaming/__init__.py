"""Annotated files that keep arriving."""
