"""Column builders: everything here stays inside Spark expressions."""
