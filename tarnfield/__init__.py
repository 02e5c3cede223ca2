"""Retrieval pipelines and experiment analytics as Spark DataFrame plans."""
