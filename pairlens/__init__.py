"""Contract matching and spread analytics on Spark DataFrames."""
