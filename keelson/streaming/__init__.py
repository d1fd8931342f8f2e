"""Structured Streaming jobs over the prediction log."""
