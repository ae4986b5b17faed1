"""New raw objects as a stream."""
