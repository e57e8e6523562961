"""Operators of a training-data pipeline over documents, pages and conversations.

Nothing else in the package imports this one. Every operator takes DataFrames and parameters
and returns a DataFrame; ``queries`` binds them to the test tables.
"""
