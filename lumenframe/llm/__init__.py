"""Operators of a large training-data pipeline over Spark DataFrames of documents and pages."""
