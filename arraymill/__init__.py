"""Column, array and tensor analytics on Spark DataFrames."""
