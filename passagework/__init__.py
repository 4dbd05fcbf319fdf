"""Passage-retrieval analytics on Spark DataFrames."""
