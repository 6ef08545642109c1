"""Rows behind reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.functions import text
from cipherledger.operators.enrich import explode_compliance
from cipherledger.operators.findings import first_rows
from cipherledger.operators.post import severity_order

DASH = "—"


def finding_rows(findings: DataFrame) -> DataFrame:
    """One display row per finding; sort by sev_ord and ord to show."""
    return findings.select(
        severity_order(F.col("severity")).alias("sev_ord"), "ord",
        "severity", "quantum_risk", F.col("algorithm.name").alias("algorithm"),
        F.concat_ws(":", "location.file_path", "location.line_number").alias("place"),
        text.basename(F.col("location.file_path")).alias("file_name"),
        "message",
        F.coalesce(F.nullif("recommendation", F.lit("")), F.lit(DASH)).alias("recommendation"),
    )


def compliance_rows(findings: DataFrame, frameworks: list[str] | None = None) -> DataFrame:
    """One display row per finding and requirement."""
    return explode_compliance(findings, frameworks).select(
        severity_order(F.col("severity")).alias("sev_ord"), "ord", "requirement_ord",
        F.col("algorithm.name").alias("algorithm"),
        F.concat_ws(":", "location.file_path", "location.line_number").alias("place"),
        "framework", "requirement_id", "description", "status",
        F.initcap(F.replace("status", F.lit("_"), F.lit(" "))).alias("status_display"), "deadline",
    )


def unique_recommendations(findings: DataFrame) -> DataFrame:
    """First recommendation per algorithm, most severe finding first."""
    told = findings.where(F.coalesce(F.col("recommendation"), F.lit("")) != "").select(
        F.col("algorithm.name").alias("algorithm"), "recommendation",
        F.array_join(F.coalesce("algorithm.pqc_replacements", F.array().cast("array<string>")), ", ").alias("replacements"),
        severity_order(F.col("severity")).alias("sev_ord"), "ord",
    )
    return first_rows(told, ["algorithm"], ["sev_ord", "ord"], 1).withColumn(
        "replacements", F.when(F.col("replacements") == "", F.lit(DASH)).otherwise(F.col("replacements"))
    )


def top_findings(findings: DataFrame, shown: int = 5) -> DataFrame:
    """The first findings by severity, each with the number of those left out."""
    total = findings.agg(F.count("*").alias("total"))
    best = findings.withColumn("sev_ord", severity_order(F.col("severity"))).orderBy("sev_ord", "ord").limit(shown)
    return best.crossJoin(F.broadcast(total)).withColumn("left_out", F.greatest(F.col("total") - shown, F.lit(0))).withColumn(
        # at most `shown` rows reach this window
        "position", F.row_number().over(Window.orderBy("sev_ord", "ord"))
    )
