"""Structured Streaming: sources, windows, scoring and sinks."""
