"""Delay-distribution analytics on Spark DataFrames."""
