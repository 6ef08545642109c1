"""One pass over texts for any number of detectors.

A detector turns a text into an array of hits, inside the row that holds the
text. Arrays of several detectors are joined and unrolled once, so a scan reads
its files once however many detectors run, shuffles nothing and gathers
nothing. What a hit shares with its rule comes from one broadcast join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherledger import schema
from cipherledger.fixed.dimensions import DETECTORS
from cipherledger.functions import text
from cipherledger.operators import enrich
from cipherledger.sources import rules as rule_tables

HITS = (
    "array<struct<rule_ord:int,tail:string,subject:string,line_number:int,line:string,context_before:array<string>,"
    "context_after:array<string>,a:bigint,b:bigint,c:bigint>>"
)


@dataclass(frozen=True)
class Rule:
    """What all findings of a rule have in common.

    A hit may add a tail to the rule id and a subject to message and
    recommendation.
    """

    rule_id: str
    scanner: str
    severity: str
    quantum_risk: str
    algorithm: dict
    message: str
    recommendation: str
    pattern: str | None = None
    language: str | None = None
    confidence: float = 1.0


@dataclass(frozen=True)
class Detector:
    """Rules with the columns and the hits made from them.

    ``prepared`` are columns over (path, name, suffix, length, content), worked
    out before the text is cut; ``wants_lines`` says over them whether the text
    has to be cut at all; ``hits`` is the array, over all of these and
    ``lines``.
    """

    rules: list[Rule]
    hits: Column
    prepared: dict[str, Column] = field(default_factory=dict)
    wants_lines: Column | None = None


# builds a detector whose rules are numbered from the given position
Builder = Callable[[int], Detector]

_DIMENSION = T.StructType([
    T.StructField("rule_ord", T.IntegerType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("scanner_type", T.StringType()),
    T.StructField("detector", T.IntegerType()),
    T.StructField("severity", T.StringType()),
    T.StructField("quantum_risk", T.StringType()),
    T.StructField("algorithm", schema.ALGORITHM),
    T.StructField("message", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])


def hit(rule_ord: Column, number: Column, line: Column, *, a, b=0, c=0, before: Column | None = None,
        after: Column | None = None, tail: Column | None = None, subject: Column | None = None) -> Column:
    """One hit as a struct; positions may be literals."""
    def long(value):
        return (value if isinstance(value, Column) else F.lit(value)).cast("long")

    nothing = F.array().cast("array<string>")
    return F.struct(
        rule_ord.cast("int").alias("rule_ord"),
        (F.lit(None) if tail is None else tail).cast("string").alias("tail"),
        (F.lit(None) if subject is None else subject).cast("string").alias("subject"),
        number.cast("int").alias("line_number"),
        line.alias("line"),
        (nothing if before is None else before).alias("context_before"),
        (nothing if after is None else after).alias("context_after"),
        long(a).alias("a"), long(b).alias("b"), long(c).alias("c"),
    )


def line_hit(rule_ord: Column, number: Column, width: int, trim: Callable[[Column], Column] = lambda x: x, **more) -> Column:
    """A hit at a line of the column ``lines``, with neighbours when ``width`` is given."""
    lines = F.col("lines")
    around = {}
    if width:
        around = dict(before=text.context_before(lines, number, width), after=text.context_after(lines, number, width))
    return hit(rule_ord, number, trim(text.line_at(lines, number)), **around, **more)


def none() -> Column:
    return F.array().cast(HITS)


def only_if(condition: Column, hits: Column) -> Column:
    """The hits where the condition holds, nothing elsewhere."""
    return F.when(condition, hits.cast(HITS)).otherwise(none())


def assemble(builders: list[Builder]) -> list[Detector]:
    """Detectors with their rules numbered through."""
    detectors: list[Detector] = []
    for build in builders:
        detectors.append(build(sum(len(d.rules) for d in detectors)))
    return detectors


def find(files: DataFrame, builders: list[Builder]) -> DataFrame:
    """Findings of several detectors over texts, in one pass."""
    return find_with(files, assemble(builders))


def find_with(files: DataFrame, detectors: list[Detector]) -> DataFrame:
    """The same for assembled detectors; they are expressions and fit any files table."""
    rows, every, rules = with_arrays(files, detectors)
    return _with_rules(rows.select("path", F.inline(every)), rules)


def find_first(files: DataFrame, detectors: list[Detector]) -> DataFrame:
    """Findings with their confidence, the unlikely ones and duplicates left out (E1, R8, W1), still in one pass.

    All findings of a file stand in its row's array, so what they repeat is dropped there: the array is sorted by rule,
    line and order, and a hit goes where its left neighbour has the same rule and line. Nothing is shuffled. A path must
    name one row of ``files``.
    """
    rows, every, rules = with_arrays(files, detectors)
    return finished(rows.select("path", every.alias("hits")), rules)


def finished(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of ``path, hits``, with confidence and without the unlikely ones and duplicates; a row has all hits of its lines."""
    if not rules:
        return _with_rules(rows.select("path", F.inline("hits")), rules)
    told = text.constant([
        (("rule_id", r.rule_id), ("detector", DETECTORS.index(r.scanner)), ("confidence", float(r.confidence))) for r in rules
    ])

    def judged(hit):
        place = F.struct(
            hit["line"].alias("line_content"), hit["context_before"].alias("context_before"), hit["context_after"].alias("context_after")
        )

        def with_rule(rule):
            return F.struct(
                F.concat(rule["rule_id"], F.coalesce(hit["tail"], F.lit(""))).alias("rule_id"), hit["line_number"].alias("line_number"),
                rule["detector"].alias("detector"), hit["a"].alias("a"), hit["b"].alias("b"), hit["c"].alias("c"),
                # lower case of long lines is dear, and a lambda works out again what it names twice
                text.let(enrich.lowered_context(place), lambda around: enrich.adjusted_confidence(
                    rule["confidence"], place, F.col("in_test"), around
                )).alias("confidence"),
                hit.alias("hit"),
            )

        return text.let(F.get(told, hit["rule_ord"]), with_rule)

    def first_of_each(ordered):
        def is_first(found, i):
            left = F.get(ordered, i - 1)
            return (i == 0) | (left["rule_id"] != found["rule_id"]) | (left["line_number"] != found["line_number"])

        return F.filter(ordered, is_first)

    likely = F.filter(F.transform("hits", judged), lambda found: found["confidence"] >= enrich.MIN_CONFIDENCE)
    kept = F.transform(text.let(F.sort_array(likely), first_of_each), lambda found: F.struct(found["confidence"].alias("own"), found["hit"].alias("hit")))
    rows = rows.withColumn("in_test", enrich.is_test_path(F.col("path")))
    return _with_rules(rows.select("path", F.inline(kept)).select("path", "own", "hit.*"), rules, F.col("own"))


def with_arrays(files: DataFrame, detectors: list[Detector], keep: list[str] = (), cut: bool = False) -> tuple[DataFrame, Column, list[Rule]]:
    """Texts with what the detectors prepare, the array of all their hits, and their rules.

    ``keep`` names further columns of the texts to keep; with ``cut`` every text is cut into lines.
    """
    prepared = [column.alias(name) for d in detectors for name, column in d.prepared.items()]
    rows = files.select("path", "name", "suffix", "length", "content", *keep, *prepared)
    wanted = [d.wants_lines for d in detectors if d.wants_lines is not None]
    if cut:
        rows = rows.withColumn("lines", text.split_lines(F.col("content")))
    elif wanted:
        some = reduce(lambda x, y: x | y, [F.coalesce(w, F.lit(False)) for w in wanted])
        rows = rows.withColumn("lines", F.when(some, text.split_lines(F.col("content"))))
    every = F.concat(*[F.coalesce(d.hits.cast(HITS), none()) for d in detectors])
    return rows, every, [r for d in detectors for r in d.rules]


def _with_rules(hits: DataFrame, rules: list[Rule], confidence: Column | None = None) -> DataFrame:
    dimension = rule_tables.table(hits.sparkSession, [
        (i, r.rule_id, r.scanner, DETECTORS.index(r.scanner), r.severity, r.quantum_risk, r.algorithm, r.message,
         r.recommendation, r.confidence)
        for i, r in enumerate(rules)
    ], _DIMENSION)

    def told(column):
        return F.concat(F.col(column), F.coalesce(F.concat(F.lit(" "), "subject"), F.lit("")))

    return hits.join(F.broadcast(dimension), "rule_ord").select(
        F.concat("rule_id", F.coalesce("tail", F.lit(""))).alias("rule_id"),
        "severity",
        "quantum_risk",
        "algorithm",
        F.struct(
            F.col("path").alias("file_path"), "line_number", F.col("line").alias("line_content"), "context_before", "context_after"
        ).alias("location"),
        told("message").alias("message"),
        told("recommendation").alias("recommendation"),
        F.array().cast("array<string>").alias("compliance_refs"),
        (F.col("confidence") if confidence is None else confidence).alias("confidence"),
        "scanner_type",
        F.struct("detector", "path", "a", "b", "c").alias("ord"),
    )


def from_rows(rows: list[tuple], scanner: str, subject: str) -> list[Rule]:
    """Rules that carry their own algorithm, without key size and replacements.

    Row: (rule_id, pattern, algorithm name, family, quantum_risk, severity).
    """
    return [
        Rule(
            rule_id, scanner, severity, risk,
            dict(name=name, family=family, key_size=None, quantum_risk=risk, pqc_replacements=[], eu_deadline=None,
                 description=f"{subject}: {name}"),
            f"{subject}: {name}", rule_tables.advice(name, family, risk), pattern,
        )
        for rule_id, pattern, name, family, risk, severity in rows
    ]


def from_algorithm(rule_id: str, scanner: str, key: str, severity: str, message: str, recommendation: str,
                   quantum_risk: str | None = None, confidence: float = 1.0) -> Rule:
    """A rule whose algorithm comes from the dimension."""
    algorithm = rule_tables.algorithm(key)
    return Rule(rule_id, scanner, severity, quantum_risk or algorithm["quantum_risk"], algorithm, message, recommendation,
                confidence=confidence)
