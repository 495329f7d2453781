"""Operators for text and training-data work."""
