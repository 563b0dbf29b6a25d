"""streaming of the document retrieval engine."""
