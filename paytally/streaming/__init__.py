"""Structured Streaming ingest and checks for arriving payment files."""
