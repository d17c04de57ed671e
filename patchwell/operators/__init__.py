"""Table-level operators: DataFrames in, one DataFrame out."""
