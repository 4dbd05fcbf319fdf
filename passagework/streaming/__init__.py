"""Streaming of the passage engine."""
