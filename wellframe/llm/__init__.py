"""Operators of a training-data pipeline: archives, search, dedup, tokens, filters, classifiers.

Nothing outside this subpackage imports it.  ``registry.QUERIES`` and ``registry.ORACLES`` hold its
queries and their SQL.
"""
