"""Operators of a training-data pipeline: quality, duplicates, mixing, counting, sharding and packing."""
