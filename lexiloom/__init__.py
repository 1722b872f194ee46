"""Document analytics on Spark: text, retrieval, vectors, insight, review and media tables."""

__version__ = "0.1.0"
