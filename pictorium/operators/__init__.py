"""Lazy operators: DataFrames in, DataFrame out."""
