"""Approximate phrase search and corpus analytics on Spark DataFrames."""
