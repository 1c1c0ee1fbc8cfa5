"""Streaming of declarative dataflows."""
