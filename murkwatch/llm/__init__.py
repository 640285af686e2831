"""Operators for training-data pipelines: counting, filtering, packing, formatting, deduplication, tokenization."""
