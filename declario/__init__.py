"""Declarative information models on Spark DataFrames."""
