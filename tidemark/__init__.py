"""Text-signal analytics on PySpark: ingest, filter, classify, aggregate, compose."""
