"""Spark-native multi-label evaluation engine."""
