"""Scans and sinks of recordings and markers."""
