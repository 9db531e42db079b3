"""Table schemas, scans, request parsing and sinks."""
