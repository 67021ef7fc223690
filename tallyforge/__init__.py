"""Spark-native analytics over structured game-sheet records."""

__version__ = "0.1.0"
