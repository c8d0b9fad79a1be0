"""graphfuse: Spark-native graph-augmented retrieval."""

__version__ = "0.1.0"
