"""Sequential Monte Carlo analytics on Spark DataFrames."""
