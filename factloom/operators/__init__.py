"""Operators on fact tables: each takes DataFrames and column names and returns a DataFrame."""
