"""Operators for preparing training data: deduplication, mixing, extraction, scoring and encoding.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
