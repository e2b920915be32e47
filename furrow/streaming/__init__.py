"""Streaming ingestion of the same rows."""
