"""Operators for preparing training text: duplicates, filters, scores, formatting and packing."""
