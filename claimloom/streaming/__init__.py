"""Incremental ingestion over Structured Streaming."""
