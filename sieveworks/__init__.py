"""Spark-native analytics for building and judging training and evaluation data."""
