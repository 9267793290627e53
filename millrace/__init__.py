"""Spark-native corpus preparation, token packing and analytics."""
