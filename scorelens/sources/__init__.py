"""Readers, writers and the comment view over the driver's tables."""
