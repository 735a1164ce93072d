"""Spark-native engine for interval tables, block archives and reference sequences."""

__version__ = "0.1.0"
