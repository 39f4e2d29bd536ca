"""larkspur: a PySpark-native engine for curating large file catalogues."""
