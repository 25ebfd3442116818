"""Spark-native table and text preparation, scoring and run analytics."""
