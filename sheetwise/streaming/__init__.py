"""Incremental stage 2 with Structured Streaming (see ``incremental``)."""
