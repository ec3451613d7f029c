"""Operators of a training-data pipeline: sharding, filtering, deduplication, packing, formatting.

Nothing else in the library imports this subpackage.
"""
