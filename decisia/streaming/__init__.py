"""Structured Streaming over the same operators; beyond what batch sources ask for."""
