"""Whole queries: a scan, and what follows from its findings."""
