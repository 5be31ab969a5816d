"""Plans of the cadenza engine."""
