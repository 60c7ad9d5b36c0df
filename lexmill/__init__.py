"""A PySpark-native engine for estimating, pruning and exporting n-gram language models."""
