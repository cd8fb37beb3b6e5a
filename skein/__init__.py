"""Spark-native analytics for social-media datasets."""
