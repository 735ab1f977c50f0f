"""Fathomline: semantic document retrieval and corpus processing on Spark DataFrames."""
