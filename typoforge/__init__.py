"""A Spark-native engine for datasets of source code with spelling typos in its names."""
