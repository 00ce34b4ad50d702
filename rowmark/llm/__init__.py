"""Operators for large text corpora: deduplication, extraction, scoring, tokens, shards."""
