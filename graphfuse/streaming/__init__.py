"""The ingest queue on Structured Streaming."""
