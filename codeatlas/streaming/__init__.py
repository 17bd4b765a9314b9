"""Structured Streaming forms of the maintenance loop."""
