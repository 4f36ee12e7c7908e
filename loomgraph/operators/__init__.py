"""Index, query, queue and status operators: DataFrames in, lazy DataFrames out."""
