"""Campaign analytics on Spark DataFrames."""
