"""A Spark-native catalogue of the constants found in software artifacts."""
