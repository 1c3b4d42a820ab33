"""Earth-observation tables on Spark: every operation is a function from DataFrames to a DataFrame."""
