"""Marketing and sales analytics on Spark DataFrames."""
