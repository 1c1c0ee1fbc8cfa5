"""Plans of declarative dataflows."""
