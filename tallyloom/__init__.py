"""Request-governance analytics and text-corpus processing on Spark DataFrames."""
