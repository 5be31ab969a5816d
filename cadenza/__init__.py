"""Spark-native analytics over timed performance events."""
