"""A PySpark-native engine for retrieval analytics over document collections."""
