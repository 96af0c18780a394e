"""Block analytics and adaptive encoding of byte streams and columns, on Spark DataFrames."""
