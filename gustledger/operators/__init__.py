"""Operators: every function takes DataFrames and returns lazy DataFrames."""
