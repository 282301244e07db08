"""viewspan: Q-methodology analytics on Spark DataFrames."""
