"""The query language, and registries that run several operators."""
