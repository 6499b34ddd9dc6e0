"""lectern: research-corpus analytics on Spark DataFrames."""
