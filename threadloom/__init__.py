"""Spark-first engine for conversation data."""
