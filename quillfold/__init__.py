"""Retrieval analytics over document collections as Spark DataFrame plans."""
