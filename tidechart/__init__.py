"""Ranking and engagement analytics on Spark DataFrames."""
