"""Whole runs: analysis of a dataset, its archive, and the report tables."""
