"""Operators for preparing training data: deduplication, search, scans, mixing, packing, scoring."""
