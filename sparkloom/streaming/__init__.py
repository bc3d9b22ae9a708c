"""Trace events as a stream."""
