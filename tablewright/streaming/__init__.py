"""Intentionally empty: none of the analyses in scope reads a stream."""
