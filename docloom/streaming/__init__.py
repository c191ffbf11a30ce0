"""Streams of trace events and page states (additions to the batch operators)."""
