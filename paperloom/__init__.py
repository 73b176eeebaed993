"""paperloom: document analytics on Spark DataFrames."""
