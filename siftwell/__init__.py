"""siftwell: hybrid-retrieval analytics and corpus preparation expressed as Spark DataFrames."""
