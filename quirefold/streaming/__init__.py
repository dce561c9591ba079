"""Incremental ingestion of files with Structured Streaming."""
