"""lodex: hybrid document search and document analytics on Spark DataFrames."""
