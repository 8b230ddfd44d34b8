"""Operators for training-data pipelines: cleaning, deduplication, scoring, counting and mixing of text corpora."""
