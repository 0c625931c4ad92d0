"""Column functions: text, vectors, paths, rounding, decay."""
