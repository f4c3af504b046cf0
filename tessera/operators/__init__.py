"""Operators on DataFrames, parameterised by column names."""
