"""textloom: a Spark-native engine for ranked text retrieval, paired evaluation and corpus work."""
