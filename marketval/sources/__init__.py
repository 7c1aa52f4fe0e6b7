"""Readers: recorded rows, page data, configuration tables."""
