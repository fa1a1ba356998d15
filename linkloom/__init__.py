"""linkloom: record linkage on Spark DataFrames."""
