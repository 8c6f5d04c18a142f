"""Scans, sinks and table catalogs."""
