"""Operators for building training corpora. Nothing else in the package imports this subpackage."""
