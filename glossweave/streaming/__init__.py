"""Streaming of the registry-annotation engine."""
