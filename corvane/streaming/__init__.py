"""Structured Streaming: rates, limits, memory compaction and incremental ingest over event streams."""
