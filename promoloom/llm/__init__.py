"""Operators for preparing training text: cleaning, deduplication, tokens, mixing."""
