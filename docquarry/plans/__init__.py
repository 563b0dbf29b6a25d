"""plans of the document retrieval engine."""
