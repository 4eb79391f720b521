"""tidemark: Spark-native analytics over public code-hosting activity events."""
