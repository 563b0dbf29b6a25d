"""functions of the document retrieval engine."""
