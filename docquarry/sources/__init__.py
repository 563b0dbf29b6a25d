"""sources of the document retrieval engine."""
