"""A Spark-native engine for aerial point clouds, building outlines and roof models."""
