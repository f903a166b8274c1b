"""Spark-native engine for building, querying and evaluating text-retrieval corpora as DataFrame jobs."""
