"""Scanning files as they arrive."""
