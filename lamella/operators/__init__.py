"""Operators on whole DataFrames: traversal, pooling of repeated values, statistics, validation."""
