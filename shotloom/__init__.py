"""Shot and event analytics on Spark DataFrames."""
