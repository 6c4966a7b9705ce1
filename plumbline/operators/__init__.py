"""Operators on drawing tables: every function takes and returns DataFrames keyed by drawing."""
