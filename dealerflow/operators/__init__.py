"""Operators: DataFrames and parameters in, one lazy DataFrame out."""
