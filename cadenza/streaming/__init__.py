"""Streaming of the cadenza engine."""
