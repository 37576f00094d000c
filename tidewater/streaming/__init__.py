"""Completion over Structured Streaming."""
