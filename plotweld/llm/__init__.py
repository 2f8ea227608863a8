"""Operators for training-data corpora: deduplication, search, filtering, mixing, tokenising."""
