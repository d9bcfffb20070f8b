"""Operators of a training-data pipeline (deduplication, filters, scans, encoding).

Nothing else in the library imports this subpackage.
"""
