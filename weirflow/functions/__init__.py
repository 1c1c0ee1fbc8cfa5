"""Functions of declarative dataflows."""
