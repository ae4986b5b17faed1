"""Joins that Spark has no operator for, as compositions of its own."""
