"""Spark-native analytics for large collections of labelled 3D volumes."""

__version__ = "0.1.0"
