"""Splittable sources: one class for each file format, one data source for each class."""
