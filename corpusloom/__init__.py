"""Literature-corpus analytics on Spark DataFrames."""
