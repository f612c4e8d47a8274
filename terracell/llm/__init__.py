"""Operators for preparing training text: filters, deduplication, scans, mixing, sharding, encoding.

Nothing else in the library imports this subpackage. ``queries`` holds the registered queries.
"""
