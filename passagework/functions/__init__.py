"""Functions of the passage engine."""
