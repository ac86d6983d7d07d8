"""Operators of a training-data pipeline: mixing, tokens, deduplication, language models, searches."""
