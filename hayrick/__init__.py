"""hayrick: hybrid document retrieval and corpus preparation on Spark DataFrames."""
