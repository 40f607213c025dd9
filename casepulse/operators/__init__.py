"""Operators: pure functions from DataFrames to one lazy DataFrame."""
