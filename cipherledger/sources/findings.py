"""Stored findings and report documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger import schema
from cipherledger.fixed import scoring_tables as t
from cipherledger.functions import text
from cipherledger.operators.findings import first_rows
from cipherledger.operators.running import numbered

#: Parts that a rule's findings are split into before they meet its number.
RULE_PARTS = 64


def read_findings(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A stored scan result under the fixed schema."""
    return spark.read.schema(schema.FINDING).format(kind).load(path)


def write_findings(findings: DataFrame, path: str, kind: str = "json", mode: str = "errorifexists") -> None:
    """Findings as JSON lines or parquet, written by the tasks that hold them."""
    findings.write.mode(mode).format(kind).save(path)


def as_json(findings: DataFrame) -> DataFrame:
    """One JSON document per finding."""
    return findings.select(F.to_json(F.struct(*[c for c in findings.columns if c != "ord"])).alias("json"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One row per rule in order of first appearance (P10).

    Rule ids may end in names found in texts, so there can be any number of rules; they are numbered where they are.
    """
    firsts = numbered(first_rows(findings, ["rule_id"], ["ord"], 1), ["ord"], "rule_index")
    level = {k: v[1] for k, v in t.SARIF_SEVERITY.items()}
    return firsts.select(
        F.col("rule_index").cast("int").alias("rule_index"),
        F.col("rule_id").alias("id"),
        F.struct(F.col("message").alias("text")).alias("shortDescription"),
        F.struct(F.concat("message", F.lit(". "), "recommendation").alias("text")).alias("fullDescription"),
        F.struct(
            F.col("recommendation").alias("text"),
            F.concat(
                F.lit("**Algorithm:** "), "algorithm.name", F.lit("\n\n**Quantum Risk:** "), "quantum_risk",
                F.lit("\n\n**Recommendation:** "), "recommendation",
            ).alias("markdown"),
        ).alias("help"),
        F.struct(
            text.lookup(F.col("severity"), level, "5.0").alias("security_severity"),
            F.concat(F.array(*[F.lit(tag) for tag in t.SARIF_TAGS]), F.array("quantum_risk")).alias("tags"),
        ).alias("properties"),
    )


def sarif_results(findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per finding with its rule's index and level (P10).

    Rule ids may end in names found in texts, so the number of rules has no
    fixed bound and the join carries no hint. A rule that many findings share is
    split by their places: its row is there once for each part.
    """
    rules = sarif_rules(findings) if rules is None else rules
    parts = F.explode(F.sequence(F.lit(0), F.lit(RULE_PARTS - 1)))
    index = rules.select(F.col("id").alias("rule_id"), "rule_index", parts.alias("part"))
    part = F.pmod(F.xxhash64("location.file_path", "location.line_number", "ord.a"), F.lit(RULE_PARTS)).cast("int")
    level = {k: v[0] for k, v in t.SARIF_SEVERITY.items()}
    return findings.withColumn("part", part).join(index, ["rule_id", "part"]).select(
        "ord",
        F.col("rule_id").alias("ruleId"),
        F.col("rule_index").alias("ruleIndex"),
        text.lookup(F.col("severity"), level, "warning").alias("level"),
        F.struct(F.concat(
            "message", F.lit(". Algorithm: "), "algorithm.name", F.lit(" (Quantum Risk: "), "quantum_risk", F.lit("). "), "recommendation",
        ).alias("text")).alias("message"),
        F.struct(
            F.replace("location.file_path", F.lit("\\"), F.lit("/")).alias("uri"),
            F.col("location.line_number").alias("startLine"),
            F.lit(1).alias("startColumn"),
            F.nullif("location.line_content", F.lit("")).alias("snippet"),
        ).alias("region"),
    )


def cyclonedx_components(assets: DataFrame, shown: int | None = None) -> DataFrame:
    """One component per inventory asset."""
    return assets.select(
        F.lit("cryptographic-asset").alias("type"),
        "name",
        "description",
        F.struct(
            text.lookup(F.col("asset_type"), t.COMPONENT_ASSET, "algorithm").alias("assetType"),
            text.lookup(F.col("family"), t.PRIMITIVE, "unknown").alias("primitive"),
            F.when(F.col("key_size") > 0, F.col("key_size").cast("string")).alias("parameterSetIdentifier"),
            F.when(F.size("pqc_replacements") > 0, F.col("pqc_replacements")).alias("certificationLevel"),
        ).alias("cryptoProperties"),
        F.struct("quantum_risk", "severity", F.col("occurrence_count").cast("string").alias("occurrence_count"), "family").alias("properties"),
        (F.col("locations") if shown is None else F.slice("locations", 1, shown)).alias("occurrences"),
    )
