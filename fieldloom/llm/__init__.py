"""Operators for preparing training text: filters, deduplication, scoring, formatting and packing."""
