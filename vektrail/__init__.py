"""Vektrail: a PySpark-native analytics engine for embedding tables."""

__version__ = "0.1.0"
