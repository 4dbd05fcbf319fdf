"""Sources of the passage engine."""
