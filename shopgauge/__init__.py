"""Compare the stores of a retail chain with Spark DataFrames."""
