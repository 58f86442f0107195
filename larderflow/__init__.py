"""Retail demand analytics as plain PySpark DataFrame transformations."""
