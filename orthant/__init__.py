"""Exact spatial and vector analytics on Spark DataFrames."""
