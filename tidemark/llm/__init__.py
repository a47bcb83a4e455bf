"""Operators for preparing training data: scoring, de-duplication, mixing, encoding, search."""
