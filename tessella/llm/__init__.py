"""Operators for training-data pipelines: scoring, dedup, sharding, decontamination, tokens, pages and URLs."""
