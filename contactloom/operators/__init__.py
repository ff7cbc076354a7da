"""Operators over DataFrames: mapping, profiling, deduplication."""
