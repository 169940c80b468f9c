"""Document and code retrieval analytics on Spark DataFrames."""
