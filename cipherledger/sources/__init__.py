"""Inputs and outputs: file corpora, rule tables, findings, report rows."""
