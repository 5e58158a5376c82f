"""Heterogeneous information networks, and the tables around them, on Spark DataFrames."""
