"""Streaming forms of the engine."""
