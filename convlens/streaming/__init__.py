"""Structured Streaming: the mart fed by a live activity log."""
