"""Drains and grid windows as Structured Streaming queries."""
