"""Structured Streaming twins of the operators over logs."""
