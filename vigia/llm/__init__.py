"""Operators of a large-scale training-data pipeline (text quality, deduplication, tokens, sharding)."""
