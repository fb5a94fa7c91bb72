"""Velario: finding, resolving and replacing sensitive entities, on Spark DataFrames."""
