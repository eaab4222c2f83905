"""Operators for building training data: deduplication, filtering, mixing and packing.

Nothing outside this subpackage imports it.
"""
