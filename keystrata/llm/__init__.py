"""Operators for preparing large-scale text corpora. Nothing else in the package imports this."""
