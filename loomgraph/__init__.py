"""Loomgraph: a Spark-native engine from message corpora to evidence-grounded graphs."""
