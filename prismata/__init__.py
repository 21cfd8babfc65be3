"""A Spark-native engine for embedding analytics and detection streams."""
