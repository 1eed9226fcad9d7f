"""Operators for building language-model training data.

Nothing else in ``glossweave`` imports this subpackage; it can be deleted and the
registry-annotation engine still works.
"""
