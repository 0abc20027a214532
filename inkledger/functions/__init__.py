"""Column functions: text, rounding, vectors, and the fixed word lists."""
