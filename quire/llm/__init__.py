"""Operators for preparing training text: tokenising, filtering, deduplication, output.

Nothing else in the library imports this subpackage.
"""
