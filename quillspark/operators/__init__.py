"""Operators on the library's tables: DataFrames in, DataFrames out."""
