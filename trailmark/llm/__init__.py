"""Operators of a large-scale training-data pipeline, each a function of Spark DataFrames.

Nothing else in the library imports this subpackage. ``queries`` binds the operators to the test
tables; the numbered modules hold the operators themselves.
"""
