"""lumenfold: article ingest, search and timeline processing on PySpark."""
