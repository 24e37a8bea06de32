"""Continuous ingest and upkeep."""
