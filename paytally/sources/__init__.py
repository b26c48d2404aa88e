"""Readers and writers: pain.001 XML, Arrow IPC streams, Parquet tables."""
