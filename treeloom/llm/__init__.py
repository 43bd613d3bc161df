"""Operators for large text corpora: privacy, duplicates, leakage, tokens and quality.

Nothing else in the library imports this subpackage.
"""
