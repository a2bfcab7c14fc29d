"""Document-log operators over Spark DataFrames."""
