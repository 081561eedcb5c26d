"""Relational operators: each is a function of DataFrames that returns a DataFrame."""
