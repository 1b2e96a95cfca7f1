"""Operators: the analyses as functions from DataFrames and parameters to a DataFrame."""
