"""Operators for preparing training text: scoring, formatting, filtering, deduplication, packing.

Nothing else in the library imports this subpackage.
"""
