"""Scans: landed responses, dimensions, request plans, the store, fixed-width files."""
