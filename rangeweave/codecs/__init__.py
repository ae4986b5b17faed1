"""Decoders and encoders of binary containers, without Spark."""
