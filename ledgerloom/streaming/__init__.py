"""Structured Streaming: queues, registries, limiters and windowed aggregates."""
