"""Operators for training-data pipelines: deduplication, filtering, tokenising, scoring, search, packing."""
