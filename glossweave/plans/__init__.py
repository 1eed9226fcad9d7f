"""Plans of the registry-annotation engine."""
