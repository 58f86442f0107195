"""Operators for preparing language-model training text: scoring, deduplication, extraction, search and packing."""
