"""Comparable-sales analytics over property markets, as PySpark DataFrame operators."""
