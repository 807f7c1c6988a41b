"""A Spark-native engine for river and flood data."""
