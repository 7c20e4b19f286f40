"""Field-scale crop yield estimation on Spark DataFrames."""
