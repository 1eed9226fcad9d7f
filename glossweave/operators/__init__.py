"""Operators of the registry-annotation engine."""
