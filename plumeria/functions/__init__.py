"""Column functions: codecs, vectors, texts and metadata."""
