"""Column expressions: hashing, itemsets, vectors, exact row numbers."""
