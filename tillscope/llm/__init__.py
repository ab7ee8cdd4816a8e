"""Operators for preparing training text: search, archives, deduplication, sharding, packing, tokens, scoring, filtering."""
