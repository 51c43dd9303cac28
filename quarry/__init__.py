"""Code-search analytics on Spark: segments, symbols, relations, text and vector retrieval."""
