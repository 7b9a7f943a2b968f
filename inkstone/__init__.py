"""A Spark-native engine for legacy word-processor documents and text corpora."""
