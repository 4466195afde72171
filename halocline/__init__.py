"""Spark-native analytics for tripolar ocean grids."""

__version__ = "0.1.0"
