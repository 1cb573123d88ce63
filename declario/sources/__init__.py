"""Formats: readers and writers, and the registry that finds them by name."""
