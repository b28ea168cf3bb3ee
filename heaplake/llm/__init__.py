"""Operators for training-data pipelines: percentiles, tokenisation, source mixing and truncated texts."""
