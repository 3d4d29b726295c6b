"""Live packets: deduplication, hourly counters and idempotent merges with Structured Streaming."""
