"""Spark-native analytics over hierarchical document collections."""
