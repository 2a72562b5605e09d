"""Operators for preparing training data: sampling, filtering, deduplication, encoding.

Nothing else in the library imports this subpackage.
"""
