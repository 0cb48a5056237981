"""Structured Streaming forms of the availability operators."""
