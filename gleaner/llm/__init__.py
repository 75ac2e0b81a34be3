"""Operators that prepare training text: deduplication, filtering, tokens, packing, archives."""
