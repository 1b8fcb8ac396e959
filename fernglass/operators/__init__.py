"""Operators: pure functions from DataFrames (plus an explicit clock) to a DataFrame."""
