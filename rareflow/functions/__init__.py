"""Column-level functions: hashing, cleaning, scores."""
