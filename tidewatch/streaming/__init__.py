"""Structured Streaming jobs: sources, stateful operators and sinks."""
