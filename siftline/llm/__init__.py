"""Operators of a training-data pipeline: near-dedup, tokenising, sharding, packing, scans and search."""
