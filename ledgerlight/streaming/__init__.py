"""Structured Streaming forms of the session operators."""
