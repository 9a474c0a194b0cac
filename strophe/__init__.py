"""Spark-native analysis of ordered, time-stamped text and signal records."""
