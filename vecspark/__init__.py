"""vecspark: similarity search and k-NN graphs on Spark DataFrames."""
