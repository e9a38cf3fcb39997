"""A Spark-native engine for searching collections of documents."""
