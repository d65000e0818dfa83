"""Spark-native analytics over collections of tagged, embedded items."""
