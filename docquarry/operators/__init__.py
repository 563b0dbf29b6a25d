"""operators of the document retrieval engine."""
