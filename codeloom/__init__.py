"""Property-graph analytics for source code, on Spark DataFrames."""
