"""Spark-native signal quality analytics."""
