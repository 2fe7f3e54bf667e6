"""Spark-native analytics for football tracking data."""
