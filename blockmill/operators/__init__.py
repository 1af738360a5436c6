"""Operators over block-sampled tables."""
