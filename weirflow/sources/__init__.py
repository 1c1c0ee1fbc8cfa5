"""Sources of declarative dataflows."""
