"""Structured Streaming versions of ingest, latest state, roll-up and redaction."""
