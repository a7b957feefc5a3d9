"""Readers, parsers, ingest and sinks."""
