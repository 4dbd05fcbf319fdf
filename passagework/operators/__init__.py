"""Operators of the passage engine."""
