"""Building rows of the findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherledger import schema
from cipherledger.fixed.dimensions import DETECTORS

def empty_context() -> Column:
    return F.array().cast("array<string>")


def order_by_position(scanner: str, path: Column, a=0, b=0, c=0) -> Column:
    """The total order of findings; literals are allowed for the positions."""
    place = [x if isinstance(x, Column) else F.lit(x) for x in (a, b, c)]
    return F.struct(
        F.lit(DETECTORS.index(scanner)).alias("detector"),
        path.alias("path"),
        *[p.cast("long").alias(n) for p, n in zip(place, "abc")],
    )


def as_findings(
    rows: DataFrame,
    *,
    scanner: str,
    path: Column,
    line_number: Column,
    line_content: Column,
    order: tuple,
    rule_id: Column | None = None,
    severity: Column | None = None,
    quantum_risk: Column | None = None,
    algorithm: Column | None = None,
    message: Column | None = None,
    recommendation: Column | None = None,
    before: Column | None = None,
    after: Column | None = None,
    confidence: float = 1.0,
) -> DataFrame:
    """Project any rows onto the findings schema.

    Rule attributes default to columns of the same name, as they come from a
    join with a resolved rule table.
    """
    def pick(given: Column | None, name: str) -> Column:
        return F.col(name) if given is None else given

    return rows.select(
        pick(rule_id, "rule_id").alias("rule_id"),
        pick(severity, "severity").alias("severity"),
        pick(quantum_risk, "quantum_risk").alias("quantum_risk"),
        pick(algorithm, "algorithm").alias("algorithm"),
        F.struct(
            path.alias("file_path"),
            line_number.cast("int").alias("line_number"),
            line_content.alias("line_content"),
            (empty_context() if before is None else before).alias("context_before"),
            (empty_context() if after is None else after).alias("context_after"),
        ).alias("location"),
        pick(message, "message").alias("message"),
        pick(recommendation, "recommendation").alias("recommendation"),
        empty_context().alias("compliance_refs"),
        F.lit(confidence).cast("double").alias("confidence"),
        F.lit(scanner).alias("scanner_type"),
        order_by_position(scanner, path, *order).alias("ord"),
    )


def empty_findings(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema.FINDING)


def first_rows(rows: DataFrame, group: list, order: list, keep: int) -> DataFrame:
    """The first ``keep`` rows of each group.

    Spark limits each group before the shuffle as well, so a group that holds
    most of the rows sends at most ``keep`` per task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= keep).drop("_rank")
