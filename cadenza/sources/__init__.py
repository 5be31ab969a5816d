"""Sources of the cadenza engine."""
