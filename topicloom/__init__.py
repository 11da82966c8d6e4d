"""A Spark-native engine that relates independently published tables to each other and to a topic vocabulary."""
