"""Column expressions: vectors, sets, bits and collision probabilities."""
