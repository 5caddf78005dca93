"""Merges, appends and outgoing messages."""
