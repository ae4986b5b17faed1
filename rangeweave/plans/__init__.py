"""Partition planners: pure arithmetic over attributes, as Python functions and as DataFrames."""
