"""Operators for preparing text corpora: cleaning, deduplication, token files and packing."""
