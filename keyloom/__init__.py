"""Data-structure analytics and corpus preparation as Spark DataFrames."""
