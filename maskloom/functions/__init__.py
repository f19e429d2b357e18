"""Column-level functions: text cleaning, tokens, mask kernels, hashing."""
