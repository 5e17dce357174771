"""Operators on collections of reads; each maps DataFrames to DataFrames."""
