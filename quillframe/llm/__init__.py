"""Operators for preparing training corpora: packing, counting, sharding, deduplication and filters."""
