"""Set-at-a-time retrieval, query understanding and conversation analytics on Spark DataFrames."""
