"""Core operators: DataFrames in, DataFrames out."""
