"""Micro-batch ingest, heartbeat sessions and the tables they write."""
