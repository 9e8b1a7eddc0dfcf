"""Indexed regex search and text analytics on Spark DataFrames."""
