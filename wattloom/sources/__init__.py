"""Readers and configuration tables."""
