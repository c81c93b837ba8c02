"""Scans, sinks, file decoding and table adapters."""
