"""Operators on media files, from DataFrames to DataFrames."""
