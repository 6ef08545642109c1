"""Two scans side by side, and scores over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.functions import scoring
from cipherledger.operators import aggregate
from cipherledger.operators.findings import first_rows

KEY = ["rule_id", "file_path", "algorithm_name"]


def keyed(findings: DataFrame) -> DataFrame:
    """Last finding per rule, file and algorithm, with the key as columns."""
    with_key = findings.select(
        "rule_id", F.col("location.file_path").alias("file_path"), F.col("algorithm.name").alias("algorithm_name"),
        "severity", "quantum_risk", F.col("location.line_number").alias("line_number"), "message", "ord",
    )
    return first_rows(with_key, KEY, [F.col("ord").desc()], 1)


def new_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """In the later scan only."""
    return keyed(after).join(_keys(before), KEY, "left_anti")


def resolved_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """In the earlier scan only."""
    return keyed(before).join(_keys(after), KEY, "left_anti")


def unchanged_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys in both scans."""
    return _keys(before).join(_keys(after), KEY, "left_semi")


def _keys(findings: DataFrame) -> DataFrame:
    """Distinct keys: copies of a key combine before the shuffle the join needs anyway."""
    return findings.select(
        "rule_id", F.col("location.file_path").alias("file_path"), F.col("algorithm.name").alias("algorithm_name")
    ).distinct()


def finding_status(before: DataFrame, after: DataFrame) -> DataFrame:
    """new, resolved, changed or unchanged per key."""
    return key_status(keyed(before), keyed(after))


def key_status(before: DataFrame, after: DataFrame) -> DataFrame:
    """The same from one row a key on each side, as ``keyed`` makes them and stored scans hold them.

    Changed means: same key, other severity or risk. One join answers all
    four; both sides come partitioned by the key, out of their window or out of
    their buckets.
    """
    a = before.select(*KEY, F.col("severity").alias("old_severity"), F.col("quantum_risk").alias("old_risk"), F.lit(True).alias("in_a"))
    b = after.select(*KEY, F.col("severity").alias("new_severity"), F.col("quantum_risk").alias("new_risk"), F.lit(True).alias("in_b"))
    status = (
        F.when(F.col("in_a").isNull(), F.lit("new"))
        .when(F.col("in_b").isNull(), F.lit("resolved"))
        .when((F.col("old_severity") != F.col("new_severity")) | (F.col("old_risk") != F.col("new_risk")), F.lit("changed"))
        .otherwise(F.lit("unchanged"))
    )
    return a.join(b, KEY, "full_outer").withColumn("status", status).drop("in_a", "in_b")


def compare_scans(before: DataFrame, after: DataFrame, summary_before: DataFrame, summary_after: DataFrame) -> DataFrame:
    """One row: scores, counts of new, resolved and unchanged, a sentence."""
    counts = finding_status(before, after).agg(
        F.count_if(F.col("status") == "new").alias("new_count"),
        F.count_if(F.col("status") == "resolved").alias("resolved_count"),
        F.count_if(F.col("status").isin("unchanged", "changed")).alias("unchanged_count"),
    )

    def side(summary, name):
        scan = aggregate.only_scan(summary, ["score", "grade"])
        return F.broadcast(scan.select(F.col("score").alias(f"score_{name}"), F.col("grade").alias(f"grade_{name}")))

    return (
        counts.crossJoin(side(summary_before, "a")).crossJoin(side(summary_after, "b"))
        .withColumn("score_change", F.bround(F.col("score_b") - F.col("score_a"), 1))
        .withColumn("summary", comparison_text())
    )


def comparison_text() -> Column:
    return F.concat_ws(
        ". ",
        scoring.change_text(F.col("score_change")),
        F.concat(F.lit("("), "grade_a", F.lit(" -> "), "grade_b", F.lit(")")),
        F.when(F.col("new_count") > 0, F.concat("new_count", F.lit(" new findings"))),
        F.when(F.col("resolved_count") > 0, F.concat("resolved_count", F.lit(" resolved findings"))),
        F.concat("unchanged_count", F.lit(" unchanged")),
    )


def score_steps(scans: DataFrame) -> DataFrame:
    """Each scan with its change against the scan before."""
    history = Window.partitionBy("target").orderBy("ts")
    return scans.withColumn("score_delta", F.col("score") - F.lag("score").over(history))


def score_trend(scans: DataFrame, goal: float = 90.0) -> DataFrame:
    """Direction, mean change and projected date of reaching a score.

    Ours, the schema alone is given: the sign of the mean change per scan
    decides the direction; a straight line through (days, score) is followed
    until it meets the goal.
    """
    days = F.unix_timestamp("ts") / 86400.0
    # the changes between neighbours add up to last minus first: no window needed
    total_change = F.max_by("score", "ts") - F.min_by("score", "ts")
    fitted = (
        scans.withColumn("day", days)
        .groupBy("target")
        .agg(
            F.count("*").alias("scans"),
            F.try_divide(total_change, F.count("*") - 1).alias("mean_delta"),
            F.regr_slope("score", "day").alias("slope"),
            F.regr_intercept("score", "day").alias("intercept"),
            F.max_by("score", "ts").alias("last_score"),
        )
    )
    day = F.try_divide(F.lit(goal) - F.col("intercept"), F.col("slope"))
    return fitted.select(
        "target", "scans",
        F.coalesce("mean_delta", F.lit(0.0)).alias("average_improvement_per_scan"),
        F.when(F.col("mean_delta") > 0, F.lit("improving")).when(F.col("mean_delta") < 0, F.lit("degrading"))
        .otherwise(F.lit("stable")).alias("score_trend"),
        F.when(
            (F.col("last_score") < goal) & (F.col("slope") > 0) & (day < 2.0e6),
            F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.ceil(day).cast("int")), "yyyy-MM-dd"),
        ).alias("projected_compliance_date"),
    )
