"""Livestock-operations analytics on Spark DataFrames."""
