"""Scans, sinks and incremental ingest."""
