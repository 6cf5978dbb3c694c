"""Operators for building large-scale training corpora. Nothing else in the library imports this."""
