"""A PySpark-native engine for memory retrieval, consolidation and corpus preparation."""
