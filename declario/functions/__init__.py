"""Scalar functions: every one takes and returns columns and stays in the JVM."""
