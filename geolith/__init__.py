"""Spatial analytics on PySpark."""
