"""Structured Streaming: event-time windows, deduplication, expiry, keyed state."""
