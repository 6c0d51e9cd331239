"""Incremental ingest of landed responses."""
