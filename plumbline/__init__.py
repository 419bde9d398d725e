"""A tabular audit engine on Spark DataFrames."""
