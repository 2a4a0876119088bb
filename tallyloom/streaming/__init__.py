"""Incremental forms of the batch transforms, over Structured Streaming."""
