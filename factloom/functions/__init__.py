"""Column functions: text, positions, paths, colours, codes, nested values."""
