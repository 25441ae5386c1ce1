"""termweave: a Spark-native engine that resolves free-text names to vocabulary entries."""
