"""Tidemark: a PySpark-native engine for partitioned data assets and their logs."""
