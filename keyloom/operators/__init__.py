"""One module for each data structure: DataFrames in, DataFrames out, nothing mutated.

A read returns rows; a write returns the new snapshot of its table.
"""
