"""nava: a Spark-native engine for building, auditing and measuring speech and text corpora."""
