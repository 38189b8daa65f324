"""Co-occurrence graph analytics on Spark: contexts, counts, correlation and similarity graphs, clusters, concepts."""

__version__ = "0.1.0"
