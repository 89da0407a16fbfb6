"""Wildfire analytics and data processing as PySpark DataFrame operators."""
