"""Structured Streaming; an extension."""
