"""Operators for preparing training text: dedup, labelling, search, packing, sharding."""
