"""Aggregates over findings: summary, scores, inventory, gaps, debt.

Large inputs meet only aggregates with fixed-width buffers or a bounded number
of rows per group; lists are cut to their reported length before they are
gathered, so a group that holds most findings is never collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.fixed import compliance_rules, dimensions, scoring_tables as t
from cipherledger.functions import scoring, text
from cipherledger.operators.enrich import compliance_refs
from cipherledger.operators.findings import first_rows
from cipherledger.operators.post import not_safe, severity_order, severity_weight

SEVERITY_NAMES = [name for name, _, _ in dimensions.SEVERITIES]


def severity_name(order: Column) -> Column:
    return text.lookup(order, {o: name for name, o, _ in dimensions.SEVERITIES})


def summarise(findings: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per scan: counts, files, score, grade, readiness (A1 to A3).

    ``files_scanned`` counts files with findings. Without findings the score
    and the readiness are 100.
    """
    return _summary(findings.select(*by, "severity", "quantum_risk", F.col("location.file_path").alias("_file"), F.lit(1).alias("n")), by)


def summary_state(findings: DataFrame, by: list[str] = ()) -> DataFrame:
    """What a summary is made of, as rows that add up: findings by file, severity and risk.

    States of parts of a scan are put together by ``merged_state``, and a state follows a scan's changes without the rest of
    the scan being read again (``updated_state``).
    """
    return findings.groupBy(*by, F.col("location.file_path").alias("file_path"), "severity", "quantum_risk").agg(F.count("*").alias("n"))


def merged_state(states: list[DataFrame], by: list[str] = ()) -> DataFrame:
    """Several states as one; what adds up to nothing goes."""
    together = reduce(DataFrame.unionByName, states)
    return together.groupBy(*by, "file_path", "severity", "quantum_risk").agg(F.sum("n").alias("n")).where("n <> 0")


def updated_state(state: DataFrame, new: DataFrame, resolved: DataFrame, by: list[str] = ()) -> DataFrame:
    """The state after findings have come and gone; only these are read, each as often as it came or went."""
    gone = summary_state(resolved, by).withColumn("n", -F.col("n"))
    return merged_state([state, summary_state(new, by), gone], by)


def summary_of_state(state: DataFrame, by: list[str] = ()) -> DataFrame:
    """The summary (A1 to A3) of a state; the same row that ``summarise`` gives for its findings."""
    return _summary(state.withColumnRenamed("file_path", "_file"), by)


def _summary(counted: DataFrame, by: list[str]) -> DataFrame:
    """Summary of rows with their number ``n``."""
    n = F.col("n")

    def having(condition) -> Column:
        return F.coalesce(F.sum(F.when(condition, n).otherwise(0)), F.lit(0))

    def count_map(column: str, levels: list[str]) -> Column:
        counts = F.map_from_arrays(F.array(*[F.lit(x) for x in levels]), F.array(*[having(F.col(column) == x) for x in levels]))
        return F.map_filter(counts, lambda _, count: count > 0)

    total = F.coalesce(F.sum(n), F.lit(0))
    weighed = F.coalesce(F.sum(severity_weight(F.col("severity")) * n), F.lit(0.0))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - weighed))
    safe = F.coalesce(F.try_divide(having(F.col("quantum_risk") == "safe") * 100.0, total), F.lit(100.0))
    return (
        counted.groupBy(*by)
        .agg(
            total.alias("total_findings"),
            count_map("severity", SEVERITY_NAMES).alias("by_severity"),
            count_map("quantum_risk", dimensions.RISKS).alias("by_quantum_risk"),
            F.countDistinct("_file").alias("files_scanned"),
            raw.alias("raw_score"),
            F.bround(safe, 1).alias("pqc_readiness_pct"),
        )
        .withColumn("score", F.bround("raw_score", 1))
        .withColumn("grade", scoring.grade(F.col("raw_score")))
        .drop("raw_score")
    )


def advanced_of_state(state: DataFrame, files_scanned: int | Column, by: list[str] = ()) -> DataFrame:
    """The advanced score (A4) of a state."""
    return _advanced(state.withColumnRenamed("file_path", "_file"), files_scanned, by)


def advanced_score(findings: DataFrame, files_scanned: int | Column, by: list[str] = ()) -> DataFrame:
    """Score with heavier severities and the share of affected files (A4)."""
    counted = findings.select(*by, "severity", F.col("location.file_path").alias("_file"), F.lit(1).alias("n"))
    return _advanced(counted, files_scanned, by)


def _advanced(counted: DataFrame, files_scanned: int | Column, by: list[str]) -> DataFrame:
    scanned = files_scanned if isinstance(files_scanned, Column) else F.lit(files_scanned)
    weight = severity_weight(F.col("severity")) * text.lookup(F.col("severity"), t.ADVANCED_MULTIPLIER, 1.0)
    sums = counted.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(weight * F.col("n")).alias("penalty"), F.countDistinct("_file").alias("affected_files")
    )
    adjusted = F.col("penalty") * (F.lit(1.0) + F.col("affected_files") / scanned)
    return sums.select(
        *by,
        "affected_files",
        F.when((F.col("n") == 0) | (scanned == 0), F.lit(100.0))
        .otherwise(F.bround(scoring.clip(100.0 - adjusted, 0.0, 100.0), 1)).alias("advanced_score"),
    )


def top_paths(findings: DataFrame, key: Column, name: str, keep: int, alias: str) -> DataFrame:
    """The first ``keep`` distinct file paths per key, sorted.

    Paths are made distinct and cut to ``keep`` per key before any is gathered.
    """
    distinct = findings.select(key.alias(name), F.col("location.file_path").alias("path")).distinct()
    kept = first_rows(distinct, [name], ["path"], keep)
    return kept.groupBy(name).agg(F.sort_array(F.collect_list("path")).alias(alias))


def only_scan(summary: DataFrame, columns: list[str]) -> DataFrame:
    """The row of a summary of one scan; a summary of several is an error, not a choice."""
    rows = summary.agg(F.count("*").alias("_scans"), *[F.first(c).alias(c) for c in columns])
    several = F.raise_error(F.lit("the summary holds several scans; choose one first")).cast("boolean")
    return rows.where(F.when(F.col("_scans") > 1, several).otherwise(F.col("_scans") == 1)).select(*columns)


def worst_risk(first: Column) -> Column:
    """vulnerable beats weakened beats the first finding's own risk."""
    return (
        F.when(F.max(F.col("quantum_risk") == "vulnerable"), F.lit("vulnerable"))
        .when(F.max(F.col("quantum_risk") == "weakened"), F.lit("weakened"))
        .otherwise(first)
    )


def inventory_locations(findings: DataFrame) -> DataFrame:
    """Every file of every asset, one row each (A5)."""
    return findings.select(F.col("algorithm.name").alias("name"), F.col("location.file_path").alias("file_path")).distinct()


def crypto_inventory(findings: DataFrame, locations: int | None = None) -> DataFrame:
    """One asset per algorithm name (A5).

    ``inventory_locations`` has all files of the assets; with ``locations`` each
    asset lists its first ones as well, else none.
    """
    narrow = findings.select(
        F.col("algorithm.name").alias("name"), "quantum_risk", "ord",
        severity_order(F.col("severity")).alias("sev_ord"),
        F.struct(
            F.col("algorithm.family").alias("family"),
            F.col("algorithm.key_size").alias("key_size"),
            F.col("algorithm.pqc_replacements").alias("pqc_replacements"),
            F.col("algorithm.description").alias("description"),
            "quantum_risk",
            "scanner_type",
        ).alias("meta"),
    )
    first = F.min_by("meta", "ord")
    assets = narrow.groupBy("name").agg(
        F.count("*").alias("occurrence_count"),
        first.alias("first"),
        worst_risk(first["quantum_risk"]).alias("quantum_risk"),
        severity_name(F.min("sev_ord")).alias("severity"),
    )
    if locations is None:
        listed = assets.withColumn("locations", F.array().cast("array<string>"))
    else:
        listed = assets.join(top_paths(findings, F.col("algorithm.name"), "name", locations, "locations"), "name")
    return listed.select(
        "name",
        text.lookup(F.col("first.scanner_type"), t.ASSET_OF_DETECTOR, "algorithm").alias("asset_type"),
        "first.family", "first.key_size", "quantum_risk", "severity", "occurrence_count", "locations",
        "first.pqc_replacements", "first.description",
    )


def inventory_totals(assets: DataFrame) -> DataFrame:
    """Algorithms in total and by worst risk."""
    def having(risk):
        return F.count_if(F.col("quantum_risk") == risk)

    return assets.agg(
        F.count("*").alias("total_algorithms"),
        having("vulnerable").alias("vulnerable_count"),
        having("weakened").alias("weakened_count"),
        having("safe").alias("safe_count"),
    )


def compliance_gaps(findings: DataFrame, frameworks: list[str] | None = None, shown: int | None = None) -> DataFrame:
    """Gaps per framework (A10), all of them or the first ``shown``.

    Requirements depend on family, risk and key size alone, so findings are
    first counted by those; the references are spelled out for a few hundred
    groups, not for every finding.
    """
    profiles = findings.groupBy(
        F.col("algorithm.family").alias("family"), F.col("algorithm.key_size").alias("key_size"), "quantum_risk"
    ).agg(F.count("*").alias("n"))
    refs = profiles.select(
        "n",
        F.inline(compliance_refs("family", "quantum_risk", "key_size", "'-'", frameworks)),
    )

    def having(status):
        return F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n"))), F.lit(0))

    gap = F.when(F.col("status") == "non_compliant", F.concat("requirement_id", F.lit(": "), "description"))
    # at most one entry per requirement and family of the fixed table
    gaps = F.sort_array(F.collect_set(gap))
    compliant, broken, open_ = having("compliant"), having("non_compliant"), having("action_required")
    return refs.groupBy("framework").agg(
        F.sum("n").alias("total_findings_checked"),
        compliant.alias("compliant_count"),
        broken.alias("non_compliant_count"),
        open_.alias("action_required_count"),
        F.coalesce(
            F.bround(F.try_divide(compliant * 100.0, compliant + broken + open_), 1), F.lit(100.0)
        ).alias("compliance_percentage"),
        (gaps if shown is None else F.slice(gaps, 1, shown)).alias("critical_gaps"),
        F.min("deadline").alias("earliest_deadline"),
    )


def gap_totals(gaps: DataFrame) -> DataFrame:
    """Mean share, total gaps, framework with the lowest share."""
    return gaps.agg(
        F.coalesce(F.bround(F.avg("compliance_percentage"), 1), F.lit(0.0)).alias("overall_compliance_pct"),
        F.coalesce(F.sum("non_compliant_count"), F.lit(0)).alias("total_gaps"),
        F.coalesce(F.min_by("framework", F.struct("compliance_percentage", "framework")), F.lit("")).alias("most_critical_framework"),
    )


def debt_category(family: Column, risk: Column) -> Column:
    return (
        F.when(family.isin(compliance_rules.BROKEN), F.lit("classically_broken"))
        .when(family.isin(compliance_rules.HASH), F.lit("hash_deprecated"))
        .when(family.isin(compliance_rules.ASYM) & (risk == "vulnerable"), F.lit("asymmetric_vulnerable"))
        .when(risk == "weakened", F.lit("symmetric_weakened"))
        .otherwise(F.lit("other"))
    )


def debt_by_category(findings: DataFrame) -> DataFrame:
    """Debt points per category."""
    category = debt_category(F.col("algorithm.family"), F.col("quantum_risk"))
    points = text.lookup(F.col("category"), t.DEBT_WEIGHT, 1.0) * text.lookup(F.col("severity"), t.DEBT_SEVERITY, 1.0)
    return (
        not_safe(findings).withColumn("category", category)
        # counts per category and severity are whole numbers, hence the same whatever the partitioning
        .groupBy("category", "severity").agg(F.count("*").alias("n"))
        .groupBy("category").agg(F.sum(F.col("n") * points).alias("points"))
    )


def crypto_debt(findings: DataFrame) -> DataFrame:
    """Debt in total, by category, with hours and yearly interest."""
    totals = debt_by_category(findings).agg(
        F.coalesce(F.sum("points"), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("category") == "asymmetric_vulnerable", F.col("points"))), F.lit(0.0)).alias("asymmetric"),
        # five categories at most
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "points")))).alias("debt_by_category"),
    )
    return totals.select(
        F.bround("total", 1).alias("total_debt_score"),
        "debt_by_category",
        F.bround(F.col("total") * 2.0, 1).alias("estimated_remediation_hours"),
        F.bround(F.col("asymmetric") / F.greatest("total", F.lit(1.0)) * 15.0, 1).alias("debt_interest_rate"),
    )


def distribution(findings: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Count and share per level, levels without findings included."""
    counts = findings.agg(
        F.count("*").alias("total"), *[F.count_if(F.col(column) == level).alias(level) for level in levels]
    )
    rows = F.array(*[
        F.struct(F.lit(i).alias("level_ord"), F.lit(level).alias("level"), F.col(level).alias("n")) for i, level in enumerate(levels)
    ])
    return counts.select("total", F.inline(rows)).select(
        "level_ord", "level", "n",
        F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("total")), F.lit(0.0)).alias("pct"),
    )


def severity_distribution(findings: DataFrame) -> DataFrame:
    return distribution(findings, "severity", SEVERITY_NAMES)


def risk_distribution(findings: DataFrame) -> DataFrame:
    return distribution(findings, "quantum_risk", dimensions.RISKS)


def timelines(findings: DataFrame) -> DataFrame:
    """Break years per family and key size; the first finding's risk decides."""
    firsts = findings.groupBy(
        F.col("algorithm.family").alias("family"), F.col("algorithm.key_size").alias("key_size")
    ).agg(F.min_by("quantum_risk", "ord").alias("quantum_risk"))
    projected = scoring.timeline(F.col("family"), F.col("key_size"), F.col("quantum_risk"))
    return firsts.withColumn("timeline", projected).where(F.col("timeline").isNotNull()).select(
        F.concat("family", F.lit("-"), F.coalesce(F.col("key_size").cast("string"), F.lit("None"))).alias("timeline_key"),
        "family", "key_size", "timeline.*",
    )


def distinct_references(findings: DataFrame, shown: int | None = None) -> DataFrame:
    """Distinct compliance strings (A15), or the first ``shown`` in order."""
    refs = findings.select(F.explode("compliance_refs").alias("reference")).distinct()
    return refs if shown is None else refs.orderBy("reference").limit(shown)


def quality_gate(summary: DataFrame, min_score: float = 70.0, max_critical: int = 0, max_high: int = 5) -> DataFrame:
    """Pass or fail with reasons, from a summary."""
    critical = F.coalesce(F.try_element_at("by_severity", F.lit("critical")), F.lit(0))
    high = F.coalesce(F.try_element_at("by_severity", F.lit("high")), F.lit(0))
    reasons = scoring.gate_reasons(F.col("score"), critical, high, min_score, max_critical, max_high)
    return summary.select("score", "grade", critical.alias("critical_count"), high.alias("high_count"), reasons.alias("reasons")).withColumn(
        "passed", F.size("reasons") == 0
    )
