"""Filters, duplicates, order, union of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.fixed.dimensions import SEVERITIES
from cipherledger.functions import text
from cipherledger.operators.findings import first_rows

_ORDER = {name: order for name, order, _ in SEVERITIES}
_WEIGHT = {name: weight for name, _, weight in SEVERITIES}


def severity_order(severity: Column) -> Column:
    return text.lookup(severity, _ORDER, len(_ORDER))


def severity_weight(severity: Column) -> Column:
    return text.lookup(severity, _WEIGHT)


def severities_from(minimum: str) -> list[str]:
    return [name for name, order, _ in SEVERITIES if order <= _ORDER[minimum]]


def at_least(findings: DataFrame, minimum: str) -> DataFrame:
    """Findings at or above a severity."""
    return findings.where(F.col("severity").isin(severities_from(minimum)))


def quantum_exposed(findings: DataFrame) -> DataFrame:
    """Findings to plan for: vulnerable or weakened."""
    return findings.where(F.col("quantum_risk").isin("vulnerable", "weakened"))


def not_safe(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("quantum_risk") != "safe")


def deduplicate(findings: DataFrame) -> DataFrame:
    """First finding per rule, file and line."""
    return first_rows(findings, ["rule_id", "location.file_path", "location.line_number"], ["ord"], 1)


def deduplicate_placed(findings: DataFrame) -> DataFrame:
    """The same for findings whose order names their own path, as ``as_findings`` makes them.

    Path and line go through the shuffle and its sorts once, not again in ``location``, ``ord`` and the window's keys.
    """
    fields = {name: findings.schema[name].dataType.names for name in ("location", "ord")}

    def flat(name, field):
        return "_location_file_path" if (name, field) == ("ord", "path") else f"_{name}_{field}"

    own = [c for c in findings.columns if c not in fields]
    narrow = findings.select(*own, *[
        F.col(f"{name}.{field}").alias(flat(name, field)) for name in fields for field in fields[name] if (name, field) != ("ord", "path")
    ])
    order = [flat("ord", field) for field in fields["ord"] if field != "path"]
    kept = first_rows(narrow, ["rule_id", "_location_file_path", "_location_line_number"], order, 1)
    made = {name: F.struct(*[F.col(flat(name, field)).alias(field) for field in fields[name]]).alias(name) for name in fields}
    return kept.select(*[made.get(c, F.col(c)) for c in findings.columns])


def by_severity(findings: DataFrame) -> DataFrame:
    """Most severe first, stable."""
    return findings.orderBy(severity_order(F.col("severity")), "ord")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All detectors' findings, duplicates kept (O1)."""
    return reduce(DataFrame.unionByName, parts)
