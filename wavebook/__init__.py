"""Cross-national survey and macro-indicator analytics on Spark DataFrames."""
