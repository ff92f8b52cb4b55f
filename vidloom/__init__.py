"""Spark-native analytics for finding similar, contained and duplicate media items."""

__version__ = "0.1.0"
