"""Column builders: labels, texts, offsets, scores."""
