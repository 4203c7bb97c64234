"""Evidence-aware access analytics on Spark DataFrames."""
