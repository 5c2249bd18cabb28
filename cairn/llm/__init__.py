"""Operators for preparing training text at scale: filters, near-duplicates, tokens, packing, archives."""
