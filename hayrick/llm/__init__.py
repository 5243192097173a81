"""Corpus preparation operators: search, sharding, deduplication, tokens, filters, mixing, models."""
