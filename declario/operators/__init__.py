"""Operators over collections: every one takes and returns DataFrames."""
