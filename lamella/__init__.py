"""Nested, self-describing records as DataFrames."""
