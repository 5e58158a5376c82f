"""Operators on networks: each takes DataFrames and returns a DataFrame, lazily."""
