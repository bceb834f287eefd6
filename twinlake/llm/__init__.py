"""Operators for training-data pipelines, on documents, pages and embeddings."""
