"""A Spark-native engine for topological data processing."""
