"""Spark-native entity resolution: deduplicate one dataset or link two."""

__version__ = "0.1.0"
