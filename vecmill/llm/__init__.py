"""Operators of a training-data pipeline.

Nothing outside this package imports it.  Every operator is a function from
DataFrames to a DataFrame; ``queries`` holds the registered queries.
"""
