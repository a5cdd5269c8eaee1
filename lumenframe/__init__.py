"""Embedding and event analytics on Spark DataFrames."""
