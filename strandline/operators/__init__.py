"""Operators: each a function of DataFrames and parameters."""
