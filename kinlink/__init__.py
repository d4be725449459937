"""A PySpark-native engine for business entity resolution."""
