"""Operators of declarative dataflows."""
