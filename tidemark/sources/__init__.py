"""Landed payloads to articles."""
