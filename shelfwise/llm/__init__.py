"""Operators of a training-data pipeline: packing, counting, deduplication, archives, mixing, search."""
