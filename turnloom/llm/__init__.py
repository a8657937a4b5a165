"""Operators for preparing training text: deduplication, decontamination, filters, classifiers, mixing and counting.

Nothing outside this package imports it.
"""
