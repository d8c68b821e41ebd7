"""Structured Streaming forms of the chat operators."""
