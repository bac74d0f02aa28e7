"""Corvane: document preparation, vector search and question answering on Spark."""
