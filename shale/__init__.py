"""Listing analytics as lazy PySpark DataFrame plans."""
