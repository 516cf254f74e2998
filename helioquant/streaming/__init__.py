"""Structured Streaming forms of the packet rules."""
