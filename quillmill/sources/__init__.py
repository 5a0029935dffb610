"""Typed scans and deterministic sinks."""
