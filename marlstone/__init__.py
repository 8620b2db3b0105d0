"""A Spark-native engine for declared-schema tables and a small SELECT dialect."""
