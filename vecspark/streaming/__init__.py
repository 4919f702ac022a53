"""Incremental index maintenance on streams."""
