"""Readers, raw-archive ingestion, dataset registry and sinks."""
