"""Spark-first knowledge-graph retrieval and text-data processing."""
