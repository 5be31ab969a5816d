"""Operators of the cadenza engine."""
