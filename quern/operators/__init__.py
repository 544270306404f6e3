"""Operators: pure functions from DataFrames to DataFrames. Ranks and ties are explicit columns and sort keys."""
