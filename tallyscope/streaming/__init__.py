"""Structured Streaming versions of the time-clustered detectors."""
