"""Structured Streaming: JSON drop folders into the catalog, change points of a stream."""
