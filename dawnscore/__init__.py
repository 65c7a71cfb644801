"""Window-score analytics on Spark: keyed DataFrames in, keyed DataFrames out."""
