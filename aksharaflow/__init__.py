"""Text and document analytics on Spark DataFrames."""
