"""Streams of review events."""
