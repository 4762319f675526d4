"""Operators for preparing training text: quality, personal data, mixing, tokens, shards, near duplicates."""
