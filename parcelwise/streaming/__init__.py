"""Incremental ingest of archive drops."""
