"""Spark-native analytics for digital document libraries."""
