"""Pattern search over text columns, on Spark DataFrames."""
