"""Readers, writers and the conversation store."""
