"""Operators for building training text: deduplication, filters, classifiers, archives and packing.

Every operator takes ``docs`` with an id and a text column (names are arguments), reads only those two columns and
leaves other columns alone.  Column names that start with ``_hl_`` are reserved for working columns.  Results that are
keyed by document carry the id column unchanged.
"""
