"""Structured Streaming forms of intake and notification."""
