"""Operators for preparing training data: scoring, deduplication, filters, packing, sharding, archives."""
