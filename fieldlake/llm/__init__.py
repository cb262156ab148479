"""Operators for large text corpora: cleaning, deduplication, scoring, mixing, formatting and archives.

Nothing else in the library imports this subpackage.
"""
