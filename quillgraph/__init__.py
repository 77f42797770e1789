"""quillgraph: lexical retrieval, edge evaluation and corpus analytics as Spark DataFrame functions."""

__version__ = "0.1.0"
