"""Runnel: ordered-flow analytics on PySpark."""
