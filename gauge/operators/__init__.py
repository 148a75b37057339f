"""Operators on DataFrames: alignment, points, catalogue, text search, history."""
