"""Medicine-name resolution, substitution and interaction analytics on Spark DataFrames."""
