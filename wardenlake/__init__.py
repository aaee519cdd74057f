"""Data and model assurance analytics as lazy PySpark plans."""
