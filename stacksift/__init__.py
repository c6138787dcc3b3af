"""Spark-native engine for curating large catalogues of media files."""
