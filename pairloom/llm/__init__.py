"""Operators of a training-data pipeline: dedup, packing, filters, tokens and models.

Nothing outside this subpackage imports it.
"""
