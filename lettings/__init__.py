"""Property letting analytics on Spark DataFrames."""
