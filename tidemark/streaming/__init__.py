"""Structured Streaming jobs for records that keep arriving."""
