"""Spark-native analytics over exposure-evidence records."""
