"""Sources of the registry-annotation engine."""
