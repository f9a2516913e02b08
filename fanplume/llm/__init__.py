"""Operators for preparing text corpora: deduplication, filtering, scoring, formatting and packing.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
