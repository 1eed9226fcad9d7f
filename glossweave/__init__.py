"""Registry-entity annotation on Spark."""
