"""Structured Streaming forms of the forward-only operators."""
