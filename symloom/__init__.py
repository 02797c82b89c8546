"""symloom: a PySpark-native engine that extracts, indexes and queries named entries in text."""
