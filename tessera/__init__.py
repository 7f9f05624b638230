"""Spark-native analytics over large multi-dimensional arrays and images."""

__version__ = "0.1.0"
