"""Document-version comparison on Spark DataFrames."""
