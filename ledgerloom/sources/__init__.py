"""Feed scans, validation and sinks."""
