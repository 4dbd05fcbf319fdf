"""Plans of the passage engine."""
