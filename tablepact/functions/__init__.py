"""Column-level functions: coercions, hashes and arithmetic expressions."""
