"""Spark-first engine for conversation exports, topic mining and search."""
