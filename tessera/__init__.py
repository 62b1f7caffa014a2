"""A PySpark-native engine for document retrieval and its data processing."""
