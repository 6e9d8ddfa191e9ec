"""chartula: document retrieval analytics on Spark DataFrames."""
