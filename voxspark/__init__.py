"""Speech-transcript analytics on Spark DataFrames."""
