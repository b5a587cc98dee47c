"""Scans, sinks and the catalog."""
