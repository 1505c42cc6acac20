"""Column functions: months, text, vectors, scores."""
