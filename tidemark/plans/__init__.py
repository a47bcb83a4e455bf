"""Compositions: views, and the queries this package registers."""
