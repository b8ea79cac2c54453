"""Structured Streaming over the events table (an extension)."""
