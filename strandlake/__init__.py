"""Spark-first engine for large collections of short strings."""
