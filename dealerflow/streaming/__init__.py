"""Incremental refresh of landed tables."""
