"""Operators for training data: filters, extraction, deduplication, scans and mixing."""
