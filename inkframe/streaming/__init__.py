"""Structured Streaming over typed text."""
