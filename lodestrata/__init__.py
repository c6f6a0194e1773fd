"""Log-structured key-value analytics on Spark DataFrames."""
