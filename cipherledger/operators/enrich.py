"""Confidence by context and compliance references."""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.fixed import compliance_rules, text_rules
from cipherledger.functions import text
from cipherledger.sources import rules as rule_tables

MIN_CONFIDENCE = 0.2


def is_test_path(path: Column) -> Column:
    """A path segment that is a test word, or a file name that contains one."""
    word = "(?:" + "|".join(text_rules.TEST_SEGMENTS) + ")"
    return F.lower(path).rlike(rf"(?:^|[/\\]){word}(?:[/\\]|$)|{word}[^/\\]*$")


def lowered_context(location: Column) -> Column:
    """The lines around a finding as one text in lower case."""
    return F.lower(F.array_join(F.concat(location["context_before"], location["context_after"]), " "))


def adjusted_confidence(finding_confidence: Column, location: Column, in_test: Column | None = None, around: Column | None = None) -> Column:
    """Confidence after five steps in this order, on plain doubles.

    A comment line sets the value, the other steps add or subtract; the order
    and the unrounded arithmetic decide what falls below the threshold.
    ``in_test`` says of the location's path what ``is_test_path`` would,
    ``around`` of its neighbours what ``lowered_context`` would.
    """
    line = location["line_content"]
    around = lowered_context(location) if around is None else around

    def when(condition, amount):
        return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))

    # each step names the value once; a value never exceeds 1 before step four
    value = finding_confidence - when(is_test_path(location["file_path"]) if in_test is None else in_test, 0.3)
    value = value - when(text.mentions(F.lower(line), text_rules.SUPPRESSIONS), 0.5)
    value = F.when(line.rlike("(?U)" + text_rules.COMMENT_LINE), F.lit(0.1)).otherwise(value)
    value = F.least(value + when(text.mentions(around, text_rules.SENSITIVE_WORDS), 0.2), F.lit(1.0))
    value = value - when(text.mentions(around, text_rules.DEMO_WORDS), 0.2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def adjust_confidence(findings: DataFrame) -> DataFrame:
    """Set the confidence and drop what falls below the minimum.

    The value is kept or dropped inside a one-element array: a plain filter on
    it would be pushed below the projection and work it out twice. All of it
    stays in generated code.
    """
    value = adjusted_confidence(F.col("confidence"), F.col("location"))
    none = F.lit(-1.0)
    kept = F.array_remove(F.array(F.when(value >= MIN_CONFIDENCE, value).otherwise(none)), none)
    others = [c for c in findings.columns if c != "confidence"]
    return findings.select(*others, F.explode(kept).alias("confidence")).select(*findings.columns)


def sql_literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tests(row: tuple, family: str, risk: str, key_size: str) -> str:
    """When a requirement applies, in SQL; a missing key size satisfies no bound."""
    _, _, families, risks, below, *_ = row
    tests = [f"{family} IN ({', '.join(map(sql_literal, families))})"] if families else []
    tests += [f"{risk} IN ({', '.join(map(sql_literal, risks))})"] if risks else []
    tests += [f"{key_size} < {below}"] if below is not None else []
    return " AND ".join(tests)


def _told(description: str, family: str, name: str) -> str:
    """A requirement's text with the finding's family and algorithm, in SQL."""
    told = sql_literal(description)
    for mark, value in (("{family}", family), ("{algorithm}", name)):
        if mark in description:
            told = f"replace({told}, '{mark}', {value})"
    return told


def compliance_refs(family: str = "algorithm.family", risk: str = "quantum_risk", key_size: str = "algorithm.key_size",
                    name: str = "algorithm.name", frameworks: list[str] | None = None) -> Column:
    """Requirements a finding falls under, as an array of structs.

    Arguments are SQL expressions over the finding. One literal test per
    condition, made in a single call.
    """
    candidates = []
    for order, row in enumerate(compliance_rules.REQUIREMENTS):
        framework, requirement, *_, status, deadline, description = row
        if frameworks is not None and framework not in frameworks:
            continue
        candidates.append(
            f"CASE WHEN {_tests(row, family, risk, key_size)} THEN named_struct('requirement_ord', {order}, 'framework', {sql_literal(framework)}, "
            f"'requirement_id', {sql_literal(requirement)}, 'description', {_told(description, family, name)}, 'status', {sql_literal(status)}, "
            f"'deadline', CAST({sql_literal(deadline)} AS STRING)) END"
        )
    return F.expr(f"filter(array({', '.join(candidates)}), ref -> ref IS NOT NULL)")


def explode_compliance(findings: DataFrame, frameworks: list[str] | None = None) -> DataFrame:
    """One row per finding and requirement.

    Which requirements hold is looked up by family, risk and class of key sizes; what they say comes from one broadcast
    join. Testing a hundred of them row by row costs far more.
    """
    families, risks, bounds = _dimensions(compliance_rules.REQUIREMENTS)
    table = {
        f"{family or ''}\n{risk or ''}\n{size}": [
            i for i, r in enumerate(compliance_rules.REQUIREMENTS)
            if (frameworks is None or r[0] in frameworks) and _applies(r, family, risk, size, bounds)
        ]
        for family in [None, *families] for risk in [None, *risks] for size in range(len(bounds) + 1)
    }
    key = F.concat_ws(
        "\n", _known(F.col("algorithm.family"), families), _known(F.col("quantum_risk"), risks), _size_class(F.col("algorithm.key_size"), bounds)
    )
    orders = F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string,array<int>>"), key)
    said = rule_tables.table(findings.sparkSession, [
        (i, r[0], r[1], r[7], r[5], r[6]) for i, r in enumerate(compliance_rules.REQUIREMENTS)
    ], "requirement_ord int, framework string, requirement_id string, description string, status string, deadline string")
    told = F.col("description")
    for mark, value in (("{family}", "algorithm.family"), ("{algorithm}", "algorithm.name")):
        told = F.when(F.contains("description", F.lit(mark)), F.replace(told, F.lit(mark), F.col(value))).otherwise(told)
    return findings.withColumn("requirement_ord", F.explode(orders)).join(F.broadcast(said), "requirement_ord").select(
        *findings.columns, "requirement_ord", "framework", "requirement_id", told.alias("description"), "status", "deadline"
    )


def _dimensions(rows: list[tuple]) -> tuple[list[str], list[str], list[int]]:
    """Families, risks and bounds of key sizes that requirements name."""
    return (
        sorted({f for r in rows for f in r[2]}), sorted({k for r in rows for k in r[3]}), sorted({r[4] for r in rows if r[4] is not None})
    )


def _known(column: Column, names: list[str]) -> Column:
    return F.when(column.isin(names), column).otherwise(F.lit("")) if names else F.lit("")


def _size_class(key_size: Column, bounds: list[int]) -> Column:
    """Number of the smallest bound that a size is below; beyond the last one no bound holds, nor for a missing size."""
    found = F.lit(str(len(bounds)))
    for i, bound in reversed(list(enumerate(bounds))):
        found = F.when(key_size < bound, F.lit(str(i))).otherwise(found)
    return found


def _applies(row: tuple, family: str | None, risk: str | None, size_class: int, bounds: list[int]) -> bool:
    """Whether a requirement holds for a family, a risk and a class of key sizes."""
    _, _, families, risks, below, *_ = row
    return (
        (not families or family in families) and (not risks or risk in risks)
        and (below is None or size_class < len(bounds) and bounds[size_class] <= below)
    )


def _filled(mark: str, column: str, told: Column) -> Column:
    return F.replace(told, F.lit(mark), F.col(column))


def compliance_strings(frameworks: list[str] | None = None) -> Column:
    """The same as strings, looked up by family, risk and class of key sizes, on which alone they depend.

    Only the algorithm's name, where a text has it, is filled in per finding.
    """
    rows = [r for r in compliance_rules.REQUIREMENTS if frameworks is None or r[0] in frameworks]
    families, risks, bounds = _dimensions(rows)

    def texts(family: str | None, risk: str | None, size_class: int) -> list[str]:
        return [
            f"{r[0]} {r[1]}: {r[7].replace('{family}', family or '{family}')}" + (f" (deadline: {r[6]})" if r[6] else "")
            for r in rows if _applies(r, family, risk, size_class, bounds)
        ]

    table = {
        family or "": {
            f"{risk or ''} {size}": texts(family, risk, size) for risk in [None, *risks] for size in range(len(bounds) + 1)
        }
        for family in [None, *families]
    }
    found = F.try_element_at(
        F.try_element_at(text.constant(table), _known(F.col("algorithm.family"), families)),
        F.concat(_known(F.col("quantum_risk"), risks), F.lit(" "), _size_class(F.col("algorithm.key_size"), bounds)),
    )
    for mark, value, left in (
        ("{algorithm}", "algorithm.name", rows), ("{family}", "algorithm.family", [r for r in rows if not r[2]]),
    ):
        if any(mark in r[7] for r in left):
            found = F.transform(found, partial(_filled, mark, value))
    return found


def attach_compliance(findings: DataFrame, frameworks: list[str] | None = None) -> DataFrame:
    """Replace the compliance strings of every finding."""
    return findings.withColumn("compliance_refs", compliance_strings(frameworks))
