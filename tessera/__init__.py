"""A search and analytics engine on Spark DataFrames."""
