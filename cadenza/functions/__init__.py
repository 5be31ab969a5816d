"""Functions of the cadenza engine."""
