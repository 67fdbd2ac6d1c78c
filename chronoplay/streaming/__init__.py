"""Structured Streaming: ingestion and stateful operators."""
