"""Functions of the registry-annotation engine."""
