"""Declarative dataflow analytics on PySpark."""
