"""Structured Streaming forms of the windowed operators."""
