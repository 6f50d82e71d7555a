"""Spark-native document processing: text rules, anchors, sources and streams as DataFrame operations."""
