"""Customer intelligence tables, scores and reports as Spark DataFrames."""
