"""Structured Streaming: the ingest stream and its stateful operators."""
