"""Content deduplication, hierarchy and set-similarity analytics on Spark DataFrames."""
