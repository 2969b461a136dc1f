"""Spark-native analytics for large collections of light curves."""
