"""Basket completion and training-data preparation as PySpark DataFrame jobs."""
