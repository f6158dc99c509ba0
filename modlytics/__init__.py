"""Content-moderation analytics on Spark DataFrames."""
