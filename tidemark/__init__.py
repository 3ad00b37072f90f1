"""Comparison of two versions of a table, as Spark DataFrame operations."""
