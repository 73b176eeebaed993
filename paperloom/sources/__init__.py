"""Readers with explicit schemas, retrieval joins, and sinks."""
