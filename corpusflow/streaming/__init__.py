"""Structured Streaming forms of the batch operators."""
