"""Operators for training corpora: mixing, filtering, deduplication, encoding."""
