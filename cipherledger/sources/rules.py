"""Rule and dimension tables as broadcastable DataFrames.

Tables here are configuration: a few hundred rows at most, checked by
``MAX_RULES`` before anything is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cipherledger import schema
from cipherledger.fixed import dimensions, scoring_tables, source_rules
from cipherledger.functions.patterns import is_valid, refused

MAX_RULES = 20_000


def table(spark: SparkSession, rows: list[tuple], fields: T.StructType | str) -> DataFrame:
    """A small driver-side table as a local relation."""
    kind = fields if isinstance(fields, T.StructType) else T._parse_datatype_string(fields)
    if len(rows) > MAX_RULES:
        raise ValueError(f"{len(rows)} rows are too many for a broadcast dimension")
    names = kind.names
    records = [dict(zip(names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(kind)), schema=kind)


@dataclass(frozen=True)
class SourceRule:
    """One line rule; texts and overrides may be left out."""

    rule_id: str
    language: str
    algorithm_key: str
    pattern: str
    message: str | None = None
    recommendation: str | None = None
    severity_override: str | None = None
    quantum_risk_override: str | None = None
    #: An algorithm of the rule's own, as a row of the dimension; else the key's.
    algorithm: tuple | None = None


_ALGORITHMS = {row[0]: row for row in dimensions.ALGORITHMS}


def advice(name: str, family: str, risk: str) -> str:
    """Recommendation composed from the headline replacement of a family."""
    options = scoring_tables.REPLACEMENTS.get(family)
    if options and risk != "safe":
        return f"Replace {name} by {options[0][1]}"
    if risk == "safe":
        return f"Keep {name}; it stands up to quantum attacks"
    return f"Review how {name} is used"


def load_source_rules(language: str | None = None, extra: list[SourceRule] = ()) -> list[SourceRule]:
    """Line rules of one language, or of all; an unknown language has none.

    ``extra`` adds a user's own rules. Rules whose pattern does not compile are
    left out.
    """
    rules = [
        SourceRule(row[0], lang, row[1], row[2], severity_override=(row + (None, None))[3],
                   quantum_risk_override=(row + (None, None))[4])
        for lang, rows in source_rules.LANGUAGES.items()
        for row in rows
    ]
    rules.extend(extra)
    return [r for r in rules if (language is None or r.language == language) and is_valid(r.pattern)]


def rules_of(table: DataFrame) -> list[SourceRule]:
    """Line rules from a table: rule_id, pattern, and ``languages`` (an array) or ``language``.

    Further columns are read if they are there: algorithm_key, message,
    recommendation, severity, quantum_risk, and for an algorithm of the rule's
    own algorithm_name, family, key_size. A rule of several languages becomes one
    for each. Tables of more than ``MAX_RULES`` rows are refused.
    """
    rows = [row.asDict() for row in table.limit(MAX_RULES + 1).collect()]
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = []
    for row in rows:
        own = None
        if row.get("algorithm_name"):
            risk = row.get("quantum_risk") or "unknown"
            own = (row["algorithm_name"], row.get("family") or "Unknown", row.get("key_size"), risk, [], None, "")
        for language in row.get("languages") or [row["language"]]:
            found.append(SourceRule(
                row["rule_id"], language, row.get("algorithm_key") or row.get("algorithm_name") or "", row["pattern"], row.get("message"),
                row.get("recommendation"), row.get("severity"), row.get("quantum_risk"), own,
            ))
    return found


def refused_rules(spark: SparkSession, rules: list[SourceRule]) -> list[tuple[str, str]]:
    """(rule_id, reason) of the rules whose pattern can't run; a scan warns of them and runs the others."""
    why = refused(spark, [r.pattern for r in rules])
    return [(r.rule_id, why[r.pattern]) for r in rules if r.pattern in why]


def algorithms(spark: SparkSession) -> DataFrame:
    """The algorithm dimension."""
    return table(spark, dimensions.ALGORITHMS, schema.ALGORITHM)


def algorithm(key: str) -> dict:
    """One row of the algorithm dimension."""
    return dict(zip(schema.ALGORITHM.names, _ALGORITHMS[key]))


def severity_dim(spark: SparkSession) -> DataFrame:
    return table(spark, dimensions.SEVERITIES, "severity string, sev_ord int, weight double")


def resolve_rules(rules: list[SourceRule]) -> list[tuple]:
    """Rules with algorithm, severity and risk filled in (L4).

    Severity is the override, else what the algorithm's risk implies; a key
    without algorithm is family Unknown, risk unknown, severity medium. The
    outcome depends on the rule alone, so it is settled once, before any match.
    """
    resolved = []
    for order, rule in enumerate(rules):
        known = rule.algorithm or _ALGORITHMS.get(rule.algorithm_key)
        algorithm = known or (rule.algorithm_key, "Unknown", None, "unknown", [], None, "")
        severity = dimensions.SEVERITY_OF_RISK[known[3]] if known else "medium"
        risk = rule.quantum_risk_override or algorithm[3]
        resolved.append((
            rule.rule_id,
            order,
            rule.language,
            rule.pattern,
            rule.severity_override or severity,
            risk,
            dict(zip(schema.ALGORITHM.names, algorithm)),
            rule.message or f"{algorithm[0]} used in {rule.language} code ({rule.rule_id})",
            rule.recommendation or advice(algorithm[0], algorithm[1], risk),
        ))
    return resolved


RESOLVED = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("rule_ord", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("quantum_risk", T.StringType()),
    T.StructField("algorithm", schema.ALGORITHM),
    T.StructField("message", T.StringType()),
    T.StructField("recommendation", T.StringType()),
])


def own_algorithm(name: Column, family: Column, risk: Column, description: Column,
                  key_size: Column | None = None, replacements: Column | None = None) -> Column:
    """Algorithm struct of detectors that do not use the dimension."""
    return F.struct(
        name.alias("name"),
        family.alias("family"),
        (F.lit(None) if key_size is None else key_size).cast("int").alias("key_size"),
        risk.alias("quantum_risk"),
        (F.array() if replacements is None else replacements).cast("array<string>").alias("pqc_replacements"),
        F.lit(None).cast("string").alias("eu_deadline"),
        description.alias("description"),
    )
