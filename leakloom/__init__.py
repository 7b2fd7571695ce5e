"""Leak-detection analytics on Spark DataFrames."""
