"""Catalogue reconciliation analytics as PySpark DataFrame functions."""
