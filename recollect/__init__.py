"""Hybrid retrieval and usage-graph analytics over tables of short documents, on Spark."""
