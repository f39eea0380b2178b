"""Evidence retrieval, ranking and case analytics on Spark DataFrames."""
