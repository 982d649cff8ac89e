"""Operators for preparing large text corpora: deduplication, tagging, encoding, packing, search."""
