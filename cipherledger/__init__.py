"""Inventory of cryptographic usage as Spark DataFrame transformations."""

from cipherledger.plans.scan import detect, finish, scan
from cipherledger.sources.files import as_text, read_files, read_targets
from cipherledger.sources.findings import read_findings, write_findings
from cipherledger.sources.rules import SourceRule, load_source_rules

__all__ = [
    "SourceRule", "as_text", "detect", "finish", "load_source_rules", "read_files", "read_findings", "read_targets",
    "scan", "write_findings",
]
