"""Content-ingestion analytics on Spark DataFrames."""
