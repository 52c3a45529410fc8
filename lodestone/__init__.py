"""Hybrid retrieval, extractive answering and corpus preparation on Spark DataFrames."""
