"""Batched, Spark-native retrieval over titled property graphs."""
