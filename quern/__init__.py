"""quern: a Spark-native engine for code and text retrieval data."""

__version__ = "0.1.0"
