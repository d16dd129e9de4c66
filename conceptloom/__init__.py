"""Entity-linking analytics on Spark DataFrames."""
