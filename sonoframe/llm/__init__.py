"""Operators for preparing text corpora: counting, filtering, joining, packing.

Nothing else in the library imports this subpackage.
"""
