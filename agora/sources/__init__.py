"""Readers, connectors and sinks."""
