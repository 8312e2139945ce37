"""A PySpark-native engine for indexing and searching collections of code and text."""
