"""Operators for preparing training data: search, sharding, filters, mixing, extraction, joins, archives, packing."""
