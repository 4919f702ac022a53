"""Operators: hashing, candidate pairs, k-NN, graphs, the index, evaluation and adapters."""
