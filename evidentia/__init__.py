"""Evidence-consensus analytics on Spark DataFrames."""
