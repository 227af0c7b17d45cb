"""Retrieval-analytics engine on Spark DataFrames."""
