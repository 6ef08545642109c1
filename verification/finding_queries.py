"""Queries over findings: confidence, compliance, aggregates, planning, comparison, reports."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from cipherledger.fixed import compliance_rules, config_rules, dimensions, endpoint_rules, scoring_tables as t, text_rules
from cipherledger.functions import scoring
from cipherledger.operators import aggregate, compare, detect_endpoints, enrich, migration, post, report
from cipherledger.plans import scan as scan_plan
from cipherledger.plans.long_scan import scan_long_files
from cipherledger.sources import findings as finding_sources
from cipherledger.sources import rules as rule_tables
from cipherledger.sources import stored
from cipherledger.sources.long_files import read_pieces
from cipherledger.sources.scans import write_scan
from verification import corpus
from verification.corpus import facts, facts_sql, literal, sql_lookup, sql_pick, sql_values
from verification.registry import query
from verification.text_queries import (
    ALGS, ANS, CFN, DOCKER, GO_SQL, JAVA_SQL, K8S, PYTHON_SQL, SECRET_RULES, SECRETS_SQL, SOURCE_SQL, SSH_SQL, STRINGS_SQL, SYMBOLS_SQL, TLS_SQL,
    document_sql, flat, sql_context, words_sql,
)

FACTS = facts_sql()
SEV_ORD = {name: order for name, order, _ in dimensions.SEVERITIES}
SEV_NAME = {order: name for name, order, _ in dimensions.SEVERITIES}
WEIGHT = {name: weight for name, _, weight in dimensions.SEVERITIES}


def sql_steps(value: str, limits: list[tuple], beyond, at_most: bool) -> str:
    sign = "<=" if at_most else ">="
    return "(CASE " + " ".join(f"WHEN {value} {sign} {limit} THEN {literal(label)}" for limit, label in limits) + f" ELSE {literal(beyond)} END)"


def sql_grade(score: str) -> str:
    return sql_steps(score, [(low, name) for name, low in t.GRADES], t.LOWEST_GRADE, False)


# -- confidence, compliance -----------------------------------------------------

_FILE = "string_split(lower(file_path), '/')[-1]"
CONFIDENCE = f"""c1 AS (SELECT *, CASE WHEN list_has_any(string_split(lower(file_path), '/'), {literal(text_rules.TEST_SEGMENTS)})
    OR {words_sql(_FILE, text_rules.TEST_SEGMENTS)} THEN CAST(1.0 AS DOUBLE) - CAST(0.3 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS v1 FROM facts),
c2 AS (SELECT *, CASE WHEN {words_sql('lower(line_content)', text_rules.SUPPRESSIONS)} THEN v1 - CAST(0.5 AS DOUBLE) ELSE v1 END AS v2 FROM c1),
c3 AS (SELECT *, CASE WHEN regexp_matches(line_content, {literal(text_rules.COMMENT_LINE)}) THEN CAST(0.1 AS DOUBLE) ELSE v2 END AS v3 FROM c2),
c4 AS (SELECT *, CASE WHEN {words_sql('lower(around)', text_rules.SENSITIVE_WORDS)} THEN least(v3 + CAST(0.2 AS DOUBLE), 1.0) ELSE v3 END AS v4 FROM c3),
c5 AS (SELECT *, CASE WHEN {words_sql('lower(around)', text_rules.DEMO_WORDS)} THEN v4 - CAST(0.2 AS DOUBLE) ELSE v4 END AS v5 FROM c4),
adjusted AS (SELECT * EXCLUDE (v1, v2, v3, v4, v5), greatest(0.0, least(1.0, v5)) AS confidence FROM c5)"""


@query("confidence", f"""WITH {FACTS}, {CONFIDENCE} SELECT rule_id, file_path, line_number, ord.a AS order_key, ord.c AS part_key, confidence
FROM adjusted WHERE confidence >= CAST(0.2 AS DOUBLE)""")
def confidence(spark, sf_dir):
    """E1, R8"""
    return enrich.adjust_confidence(facts(spark, sf_dir)).select(
        "rule_id", "location.file_path", "location.line_number", F.col("ord.a").alias("order_key"), F.col("ord.c").alias("part_key"), "confidence"
    )


# one spelled-out condition per requirement
_REF_CONDITIONS = []
for _i, (_fw, _req, _families, _risks, _below, *_rest) in enumerate(compliance_rules.REQUIREMENTS):
    _c = [f"requirement_ord = {_i}"]
    if _families:
        _c.append(f"family IN ({', '.join(literal(x) for x in _families)})")
    if _risks:
        _c.append(f"quantum_risk IN ({', '.join(literal(x) for x in _risks)})")
    if _below:
        _c.append(f"key_size < {_below}")
    _REF_CONDITIONS.append("(" + " AND ".join(_c) + ")")
REQS = sql_values(
    [(i, r[0], r[1], r[5], r[6], r[7]) for i, r in enumerate(compliance_rules.REQUIREMENTS)], "reqs",
    "requirement_ord, framework, requirement_id, status, deadline, description",
)
TOLD = "replace(replace(reqs.description, '{family}', family), '{algorithm}', name)"
REFS = f"refs AS (SELECT f.*, reqs.* EXCLUDE (description), {TOLD} AS told FROM facts f JOIN reqs ON {' OR '.join(_REF_CONDITIONS)})"


@query("compliance_references", f"""WITH {FACTS}, {REQS}, {REFS} SELECT framework, requirement_id, status, deadline, told AS description, count(*) AS findings,
  count(DISTINCT file_path) AS files FROM refs GROUP BY ALL""")
def compliance_references(spark, sf_dir):
    """C1"""
    # counted before each row becomes one for every requirement it falls under
    found = facts(spark, sf_dir).groupBy("algorithm", "quantum_risk", F.col("location.file_path").alias("file_path")).agg(F.count("*").alias("n"))
    return enrich.explode_compliance(found).groupBy("framework", "requirement_id", "status", "deadline", "description").agg(
        F.sum("n").alias("findings"), F.countDistinct("file_path").alias("files")
    )


@query("compliance_subset", f"""WITH {FACTS}, {REQS}, {REFS} SELECT framework, scan_id, count(*) AS findings FROM refs
WHERE framework IN ('NIST', 'GDPR') GROUP BY ALL""")
def compliance_subset(spark, sf_dir):
    """C1 with enabled frameworks"""
    return enrich.explode_compliance(facts(spark, sf_dir), ["NIST", "GDPR"]).groupBy("framework", "scan_id").agg(F.count("*").alias("findings"))


_REF_TEXT = "concat(framework, ' ', requirement_id, ': ', told, CASE WHEN deadline IS NOT NULL THEN concat(' (deadline: ', deadline, ')') ELSE '' END)"


@query("compliance_strings", f"""WITH {FACTS}, {REQS}, numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS row_id FROM facts),
refs AS (SELECT row_id, reqs.* EXCLUDE (description), {TOLD} AS told FROM numbered JOIN reqs ON {' OR '.join(_REF_CONDITIONS)}),
texts AS (SELECT row_id, string_agg({_REF_TEXT}, '|' ORDER BY requirement_ord) AS refs FROM refs GROUP BY row_id)
SELECT f.ord.a AS order_key, f.ord.c AS part_key, f.rule_id, coalesce(refs, '') AS refs FROM numbered f LEFT JOIN texts USING (row_id)""")
def compliance_strings(spark, sf_dir):
    """C2"""
    return enrich.attach_compliance(facts(spark, sf_dir)).select(
        F.col("ord.a").alias("order_key"), F.col("ord.c").alias("part_key"), "rule_id", F.array_join("compliance_refs", "|").alias("refs")
    )


@query("distinct_references", f"""WITH {FACTS}, {REQS}, {REFS} SELECT DISTINCT {_REF_TEXT} AS reference FROM refs""")
def distinct_references(spark, sf_dir):
    """A15"""
    return aggregate.distinct_references(enrich.attach_compliance(facts(spark, sf_dir)))


# -- filters, duplicates, order ---------------------------------------------------

PLACE = "rule_id, file_path, line_number, severity, quantum_risk, ord.a AS order_key, ord.c AS part_key"


def place(findings):
    return findings.select(
        "rule_id", "location.file_path", "location.line_number", "severity", "quantum_risk", F.col("ord.a").alias("order_key"), F.col("ord.c").alias("part_key")
    )


@query("minimum_severity", f"WITH {FACTS} SELECT {PLACE} FROM facts WHERE sev_ord <= 2")
def minimum_severity(spark, sf_dir):
    """R7"""
    return place(post.at_least(facts(spark, sf_dir), "medium"))


@query("quantum_exposed", f"WITH {FACTS} SELECT {PLACE} FROM facts WHERE quantum_risk IN ('vulnerable', 'weakened')")
def quantum_exposed(spark, sf_dir):
    """R9"""
    return place(post.quantum_exposed(facts(spark, sf_dir)))


@query("deduplicated", f"""WITH {FACTS} SELECT {PLACE} FROM facts
QUALIFY row_number() OVER (PARTITION BY rule_id, file_path, line_number ORDER BY ord) = 1""")
def deduplicated(spark, sf_dir):
    """W1"""
    return place(post.deduplicate(facts(spark, sf_dir)))


@query("severity_ranking", f"""WITH {FACTS} SELECT file_path, rule_id, CAST(row_number() OVER (PARTITION BY file_path ORDER BY sev_ord, ord) AS INTEGER) AS position,
  ord.a AS order_key FROM facts""")
def severity_ranking(spark, sf_dir):
    """The order a sort by severity gives, numbered per file"""
    from pyspark.sql import Window

    order = Window.partitionBy("location.file_path").orderBy(post.severity_order(F.col("severity")), "ord")
    return facts(spark, sf_dir).select(
        "location.file_path", "rule_id", F.row_number().over(order).alias("position"), F.col("ord.a").alias("order_key")
    )


@query("severity_sorted", f"""WITH {FACTS} SELECT {PLACE}, sev_ord::INTEGER AS level FROM facts ORDER BY sev_ord, ord""")
def severity_sorted(spark, sf_dir):
    """The sorted report, all rows"""
    ordered = post.by_severity(facts(spark, sf_dir))
    return place(ordered).withColumn("level", post.severity_order(F.col("severity")).cast("int"))


# -- summary and scores --------------------------------------------------------------


def _map_sql(column: str, levels: list[str]) -> str:
    return ", ".join(f"count(*) FILTER ({column} = {literal(level)}) AS {column}_{level}" for level in levels)


SUMMARY = """coalesce(greatest(0.0, least(100.0, 100.0 - sum(weight))), 100.0) AS raw, count(*) AS total_findings,
  count(DISTINCT file_path) AS files_scanned, coalesce(round_even(avg(CASE WHEN quantum_risk = 'safe' THEN 100.0 ELSE 0.0 END)::DOUBLE, 1), 100.0)::DOUBLE AS pqc_readiness_pct,
  count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count"""


@query("scan_summary", f"""WITH {FACTS} SELECT scan_id, total_findings, files_scanned, round_even(raw, 1)::DOUBLE AS score, {sql_grade('raw')} AS grade, pqc_readiness_pct,
  * EXCLUDE (scan_id, total_findings, files_scanned, raw, pqc_readiness_pct, critical_count, high_count) FROM (
  SELECT scan_id, {SUMMARY}, {_map_sql('severity', aggregate.SEVERITY_NAMES)}, {_map_sql('quantum_risk', dimensions.RISKS)} FROM facts GROUP BY scan_id)""")
def scan_summary(spark, sf_dir):
    """A1 to A3, per scan"""
    summary = aggregate.summarise(facts(spark, sf_dir), ["scan_id"])

    def count(column, level):
        return F.coalesce(F.try_element_at(column, F.lit(level)), F.lit(0))

    return summary.select(
        "scan_id", "total_findings", "files_scanned", "score", "grade", "pqc_readiness_pct",
        *[count("by_severity", s).alias(f"severity_{s}") for s in aggregate.SEVERITY_NAMES],
        *[count("by_quantum_risk", r).alias(f"quantum_risk_{r}") for r in dimensions.RISKS],
    )


# every (file, line) as a scan of its own: groups small enough for every grade
@query("small_scans", f"""WITH {FACTS} SELECT file_path, line_number, total_findings, round_even(raw, 1)::DOUBLE AS score, {sql_grade('raw')} AS grade, pqc_readiness_pct FROM (
  SELECT file_path, line_number, {SUMMARY} FROM facts GROUP BY file_path, line_number)""")
def small_scans(spark, sf_dir):
    """A2, A3"""
    return aggregate.summarise(_placed(spark, sf_dir), ["file_path", "line_number"]).select(
        "file_path", "line_number", "total_findings", "score", "grade", "pqc_readiness_pct"
    )


def _placed(spark, sf_dir):
    return facts(spark, sf_dir).withColumn("file_path", F.col("location.file_path")).withColumn("line_number", F.col("location.line_number"))


@query("advanced_score", f"""WITH {FACTS}, s AS (SELECT rule_id, line_number, count(DISTINCT file_path) AS affected_files, sum(weight * {sql_lookup('severity', t.ADVANCED_MULTIPLIER)}) AS penalty
  FROM facts GROUP BY rule_id, line_number)
SELECT rule_id, line_number, affected_files, round_even(greatest(0.0, least(100.0, 100.0 - penalty * (1.0 + affected_files / 200))), 1)::DOUBLE AS advanced_score FROM s""")
def advanced_score(spark, sf_dir):
    """A4, per rule and line so that scores vary"""
    return aggregate.advanced_score(_placed(spark, sf_dir), 200, ["rule_id", "line_number"])


@query("quality_gate", f"""WITH {FACTS}, s AS (SELECT {SUMMARY} FROM facts)
SELECT round_even(raw, 1)::DOUBLE AS score, {sql_grade('raw')} AS grade, critical_count, high_count, critical_count = 0 AND high_count <= 5 AND raw >= 70 AS passed,
  concat('Score ', round_even(raw, 1)::DOUBLE, ' is below minimum 70.0|Critical findings: ', critical_count, ' (max allowed: 0)|High findings: ', high_count, ' (max allowed: 5)') AS reasons FROM s""")
def quality_gate(spark, sf_dir):
    """A16, S7"""
    gate = aggregate.quality_gate(aggregate.summarise(facts(spark, sf_dir)))
    return gate.withColumn("reasons", F.array_join("reasons", "|"))


@query("score_display", f"""WITH {FACTS} SELECT file_path, line_number, concat(CAST(round_even(round_even(raw, 1), 0) AS INTEGER), '/100 (Grade ', {sql_grade('raw')}, ')') AS score_text,
  concat(CAST(round_even(pqc_readiness_pct, 0) AS INTEGER), '%') AS readiness_text FROM (SELECT file_path, line_number, {SUMMARY} FROM facts GROUP BY file_path, line_number)""")
def score_display(spark, sf_dir):
    """S9"""
    summary = aggregate.summarise(_placed(spark, sf_dir), ["file_path", "line_number"])
    return summary.select(
        "file_path", "line_number", scoring.score_text(F.col("score"), F.col("grade")).alias("score_text"),
        scoring.readiness_text(F.col("pqc_readiness_pct")).alias("readiness_text"),
    )


# -- inventory -----------------------------------------------------------------------

RISK_OF_GROUP = "CASE WHEN bool_or(quantum_risk = 'vulnerable') THEN 'vulnerable' WHEN bool_or(quantum_risk = 'weakened') THEN 'weakened' ELSE arg_min(quantum_risk, ord) END"
ASSETS = f"""paths AS (SELECT name, string_agg(file_path, '|' ORDER BY file_path) AS locations, list(file_path ORDER BY file_path) AS all_paths FROM (
    SELECT DISTINCT name, file_path FROM facts QUALIFY dense_rank() OVER (PARTITION BY name ORDER BY file_path) <= 50) GROUP BY name),
assets AS (SELECT name, count(*) AS occurrence_count, {RISK_OF_GROUP} AS quantum_risk, {sql_lookup('min(sev_ord)', SEV_NAME)} AS severity,
  {sql_lookup('arg_min(scanner_type, ord)', t.ASSET_OF_DETECTOR, 'algorithm')} AS asset_type, arg_min(family, ord) AS family,
  any_value(key_size) AS key_size, any_value(replacements) AS replacements, any_value(description) AS description FROM facts GROUP BY name)"""


@query("crypto_inventory", f"""WITH {FACTS}, {ASSETS} SELECT name, occurrence_count, quantum_risk, severity, asset_type, family, key_size, locations,
  coalesce(array_to_string(replacements, '|'), '') AS replacements, description FROM assets JOIN paths USING (name)""")
def crypto_inventory(spark, sf_dir):
    """A5, W5"""
    return aggregate.crypto_inventory(facts(spark, sf_dir), locations=50).select(
        "name", "occurrence_count", "quantum_risk", "severity", "asset_type", "family", "key_size", F.array_join("locations", "|").alias("locations"),
        F.array_join("pqc_replacements", "|").alias("replacements"), "description",
    )


@query("inventory_totals", f"""WITH {FACTS}, {ASSETS} SELECT count(*) AS total_algorithms, count(*) FILTER (quantum_risk = 'vulnerable') AS vulnerable_count,
  count(*) FILTER (quantum_risk = 'weakened') AS weakened_count, count(*) FILTER (quantum_risk = 'safe') AS safe_count FROM assets""")
def inventory_totals(spark, sf_dir):
    """A6"""
    return aggregate.inventory_totals(aggregate.crypto_inventory(facts(spark, sf_dir)))


@query("cyclonedx_components", f"""WITH {FACTS}, {ASSETS} SELECT 'cryptographic-asset' AS type, name, description, {sql_lookup('asset_type', t.COMPONENT_ASSET, 'algorithm')} AS asset_type,
  {sql_lookup('family', t.PRIMITIVE, 'unknown')} AS primitive, CAST(key_size AS VARCHAR) AS parameter_set,
  CASE WHEN len(replacements) > 0 THEN array_to_string(replacements, '|') END AS certification, CAST(occurrence_count AS VARCHAR) AS occurrences,
  quantum_risk, severity, array_to_string(all_paths[1:20], '|') AS evidence FROM assets JOIN paths USING (name)""")
def cyclonedx_components(spark, sf_dir):
    """P11"""
    components = finding_sources.cyclonedx_components(aggregate.crypto_inventory(facts(spark, sf_dir), locations=50), shown=20)
    return components.select(
        "type", "name", "description", F.col("cryptoProperties.assetType").alias("asset_type"), "cryptoProperties.primitive",
        F.col("cryptoProperties.parameterSetIdentifier").alias("parameter_set"),
        F.array_join("cryptoProperties.certificationLevel", "|").alias("certification"),
        F.col("properties.occurrence_count").alias("occurrences"), "properties.quantum_risk", "properties.severity",
        F.array_join("occurrences", "|").alias("evidence"),
    )


# -- gaps, debt, distributions ---------------------------------------------------------

GAPS = f"""gaps AS (SELECT framework, count(*) AS total_findings_checked, count(*) FILTER (status = 'compliant') AS compliant_count,
  count(*) FILTER (status = 'non_compliant') AS non_compliant_count, count(*) FILTER (status = 'action_required') AS action_required_count,
  round_even(count(*) FILTER (status = 'compliant') * 100.0 / count(*), 1)::DOUBLE AS compliance_percentage,
  coalesce(array_to_string(list_sort(list(DISTINCT concat(requirement_id, ': ', told)) FILTER (status = 'non_compliant'))[1:20], '|'), '') AS critical_gaps,
  min(deadline) AS earliest_deadline FROM refs GROUP BY framework)"""


@query("compliance_gaps", f"WITH {FACTS}, {REQS}, {REFS}, {GAPS} SELECT * FROM gaps")
def compliance_gaps(spark, sf_dir):
    """A10"""
    return aggregate.compliance_gaps(facts(spark, sf_dir), shown=20).withColumn("critical_gaps", F.array_join("critical_gaps", "|"))


@query("gap_totals", f"""WITH {FACTS}, {REQS}, {REFS}, {GAPS} SELECT coalesce(round_even(avg(compliance_percentage), 1), 0)::DOUBLE AS overall_compliance_pct,
  sum(non_compliant_count)::BIGINT AS total_gaps, arg_min(framework, {{'p': compliance_percentage, 'f': framework}}) AS most_critical_framework FROM gaps""")
def gap_totals(spark, sf_dir):
    """A11"""
    return aggregate.gap_totals(aggregate.compliance_gaps(facts(spark, sf_dir)))


def _in(column: str, values: list[str]) -> str:
    return f"{column} IN ({', '.join(literal(v) for v in values)})"


CATEGORY = (
    f"CASE WHEN {_in('family', compliance_rules.BROKEN)} THEN 'classically_broken' WHEN {_in('family', compliance_rules.HASH)} THEN 'hash_deprecated' "
    f"WHEN {_in('family', compliance_rules.ASYM)} AND quantum_risk = 'vulnerable' THEN 'asymmetric_vulnerable' WHEN quantum_risk = 'weakened' THEN 'symmetric_weakened' ELSE 'other' END"
)
DEBT = f"""scored AS (SELECT {CATEGORY} AS category, severity FROM facts WHERE quantum_risk <> 'safe'),
debt AS (SELECT category, sum({sql_lookup('category', t.DEBT_WEIGHT, 1.0)} * {sql_lookup('severity', t.DEBT_SEVERITY)} * n)::DOUBLE AS points
  FROM (SELECT category, severity, count(*) AS n FROM scored GROUP BY ALL) GROUP BY category)"""


@query("debt_by_category", f"WITH {FACTS}, {DEBT} SELECT category, round(points, 3) AS points FROM debt")
def debt_by_category(spark, sf_dir):
    """A12"""
    return aggregate.debt_by_category(facts(spark, sf_dir)).withColumn("points", F.round("points", 3))


@query("crypto_debt", f"""WITH {FACTS}, {DEBT} SELECT round_even(sum(points), 1)::DOUBLE AS total_debt_score, round_even(sum(points) * 2, 1)::DOUBLE AS estimated_remediation_hours,
  round_even(sum(points) FILTER (category = 'asymmetric_vulnerable') / greatest(sum(points), 1.0) * 15.0, 1)::DOUBLE AS debt_interest_rate, count(*) AS categories FROM debt""")
def crypto_debt(spark, sf_dir):
    """A12"""
    return aggregate.crypto_debt(facts(spark, sf_dir)).withColumn("categories", F.size("debt_by_category").cast("long")).drop("debt_by_category")


def _distribution_sql(column: str, levels: list[str]) -> str:
    return f"""WITH {FACTS}, {sql_values(list(enumerate(levels)), 'levels', 'level_ord, level')} SELECT CAST(level_ord AS INTEGER) AS level_ord, level, count(facts.{column}) AS n,
  round(count(facts.{column}) * 100.0 / (SELECT count(*) FROM facts), 9)::DOUBLE AS pct FROM levels LEFT JOIN facts ON level = {column} GROUP BY ALL"""


@query("severity_distribution", _distribution_sql("severity", aggregate.SEVERITY_NAMES))
def severity_distribution(spark, sf_dir):
    """A13"""
    return aggregate.severity_distribution(facts(spark, sf_dir)).withColumn("pct", F.round("pct", 9))


@query("risk_distribution", _distribution_sql("quantum_risk", dimensions.RISKS))
def risk_distribution(spark, sf_dir):
    """A13"""
    return aggregate.risk_distribution(facts(spark, sf_dir)).withColumn("pct", F.round("pct", 9))


# -- per-row scores ------------------------------------------------------------------

YEARS = sql_values(t.BREAK_YEARS, "years", "threshold, logical_qubits, break_year_optimistic, break_year_moderate, break_year_conservative, attack_type, timeline_confidence")
THRESHOLD = (
    "CASE WHEN quantum_risk = 'safe' THEN NULL "
    + " ".join(f"WHEN family = {literal(f)} AND key_size = {k} THEN {literal(n)}" for f, k, n in t.THRESHOLD_BY_KEY)
    + f" ELSE {sql_lookup('family', t.THRESHOLD_BY_FAMILY)} END"
)


@query("family_timelines", f"""WITH {FACTS}, {YEARS}, firsts AS (SELECT family, key_size, arg_min(quantum_risk, ord) AS quantum_risk FROM facts GROUP BY ALL),
keyed AS (SELECT *, {THRESHOLD} AS threshold FROM firsts)
SELECT concat(family, '-', coalesce(CAST(key_size AS VARCHAR), 'None')) AS timeline_key, family, key_size, years.* EXCLUDE (threshold) FROM keyed JOIN years USING (threshold)""")
def family_timelines(spark, sf_dir):
    """A14, S2"""
    return aggregate.timelines(facts(spark, sf_dir))


@query("finding_timelines", f"""WITH {FACTS}, {YEARS}, keyed AS (SELECT *, {THRESHOLD} AS threshold FROM facts)
SELECT ord.a AS order_key, ord.c AS part_key, rule_id, break_year_moderate, logical_qubits FROM keyed LEFT JOIN years USING (threshold)""")
def finding_timelines(spark, sf_dir):
    """S2"""
    projected = scoring.timeline(F.col("algorithm.family"), F.col("algorithm.key_size"), F.col("quantum_risk"))
    return facts(spark, sf_dir).withColumn("t", projected).select(
        F.col("ord.a").alias("order_key"), F.col("ord.c").alias("part_key"), "rule_id", "t.break_year_moderate", "t.logical_qubits"
    )


HNDL_LEVELS = list(t.SENSITIVITY_WEIGHT)


@query("harvest_risk", f"""WITH {FACTS}, {YEARS}, keyed AS (SELECT *, {THRESHOLD} AS threshold FROM facts),
gaps AS (SELECT *, 12 - (break_year_moderate - 2026) AS gap FROM keyed JOIN years USING (threshold))
SELECT ord.a AS order_key, ord.c AS part_key, rule_id, CAST(gap AS INTEGER) AS hndl_gap,
  round_even(least(100.0, greatest(0.0, least(100.0, (gap + 15) * 5.0)) * CAST(0.8 AS DOUBLE) * 1.5), 1)::DOUBLE AS hndl_score,
  CASE WHEN gap > 0 THEN 'immediate' WHEN gap > -5 THEN 'urgent' WHEN gap > -10 THEN 'planned' ELSE 'monitor' END AS urgency FROM gaps""")
def harvest_risk(spark, sf_dir):
    """S3"""
    projected = scoring.timeline(F.col("algorithm.family"), F.col("algorithm.key_size"), F.col("quantum_risk"))
    rows = facts(spark, sf_dir).withColumn("t", projected).where(F.col("t").isNotNull())
    return rows.withColumn("h", scoring.harvest_risk(F.col("t.break_year_moderate"), 2026, 12, "confidential")).select(
        F.col("ord.a").alias("order_key"), F.col("ord.c").alias("part_key"), "rule_id", "h.*"
    )


_STRENGTH = sql_lookup("family", {k: v[0] for k, v in t.QVSS_FAMILY.items()}, 5.0)
_PATCH = sql_lookup("family", {k: v[1] for k, v in t.QVSS_FAMILY.items()}, 5.0)


@query("qvss", f"""WITH {FACTS}, a AS (SELECT *, {sql_lookup('quantum_risk', t.QVSS_RISK)} AS vuln, {sql_lookup('quantum_risk', t.QVSS_TIMELINE)} AS near, {_PATCH} AS patch,
  CASE WHEN family = 'RSA' AND key_size <= 1024 THEN 9.5::DOUBLE WHEN family = 'RSA' AND key_size <= 2048 THEN 7.0::DOUBLE WHEN family = 'RSA' AND key_size >= 4096 THEN 5.0::DOUBLE ELSE {_STRENGTH} END AS strength FROM facts),
b AS (SELECT *, least(10.0, vuln * 0.6::DOUBLE + strength * 0.4::DOUBLE) AS base FROM a),
c AS (SELECT *, least(10.0, base * (1.0::DOUBLE + (near - patch) * 0.05::DOUBLE)) AS temporal FROM b),
d AS (SELECT *, least(10.0, temporal * (0.5::DOUBLE + (8.0::DOUBLE + 6.0 + 9.0) / 30.0::DOUBLE * 0.5::DOUBLE)) AS environmental FROM c)
SELECT ord.a AS order_key, ord.c AS part_key, rule_id, vuln AS algorithm_vulnerability, strength AS key_strength, patch AS patch_availability, near AS quantum_timeline_proximity,
  round_even(base, 1)::DOUBLE AS base_score, round_even(temporal, 1)::DOUBLE AS temporal_score, round_even(environmental, 1)::DOUBLE AS overall_score,
  {sql_steps('round_even(environmental, 1)', [(low, name) for name, low in t.QVSS_LABELS], 'None', False)} AS severity_label FROM d""")
def qvss(spark, sf_dir):
    """S1"""
    score = scoring.qvss(F.col("algorithm.family"), F.col("quantum_risk"), F.col("algorithm.key_size"), 8.0, 6.0, 9.0)
    return facts(spark, sf_dir).withColumn("q", score).select(
        F.col("ord.a").alias("order_key"), F.col("ord.c").alias("part_key"), "rule_id", "q.algorithm_vulnerability", "q.key_strength", "q.patch_availability",
        "q.quantum_timeline_proximity", "q.base_score", "q.temporal_score", "q.overall_score", "q.severity_label",
    )


USAGES = ["library_call", "tls_config", "certificate", "key_management", "custom_implementation", "hsm", "vpn", "unknown_use", "network"]
_HOURS = (
    "coalesce(CASE " + " ".join(f"WHEN family = {literal(f)} AND usage = {literal(u)} THEN {h}" for f, u, h in t.BASE_HOURS)
    + f" END, {sql_lookup('family', {f: h for f, u, h in t.BASE_HOURS if u == 'library_call'})}, {t.DEFAULT_HOURS})::DOUBLE"
)
_VENDOR = (
    "CASE WHEN fips THEN 'PQShield' WHEN usage IN ('tls_config', 'certificate', 'vpn') THEN 'QuSecure' WHEN usage IN ('hsm', 'embedded', 'hardware') THEN 'PQShield' "
    f"WHEN critical AND usage = 'key_management' THEN 'QuSecure' ELSE {sql_lookup('usage', t.VENDOR_BY_USE, 'OpenSource')} END"
)
USE_SQL = f"""uses AS (SELECT family, {sql_pick('ord.a', USAGES)} AS usage, severity = 'critical' AS critical, line_number % 11 = 0 AS fips, line_number FROM facts)"""


def _uses(spark, sf_dir):
    return facts(spark, sf_dir).select(
        F.col("algorithm.family").alias("family"), corpus.pick(F.col("ord.a"), USAGES).alias("usage"), (F.col("severity") == "critical").alias("critical"),
        (F.col("location.line_number") % 11 == 0).alias("fips"), "location.line_number",
    )


@query("effort", f"""WITH {FACTS}, {USE_SQL}, h AS (SELECT *, {_HOURS} AS hours, {sql_steps('line_number', t.FILE_MULTIPLIER, t.MANY_FILES_MULTIPLIER, True)} AS multiplier FROM uses)
SELECT family, usage, line_number, hours, multiplier, round_even(hours * multiplier * 150.0, 2)::DOUBLE AS cost_eur, {sql_steps('hours * multiplier', t.COMPLEXITY, t.MOST_COMPLEX, True)} AS complexity FROM h""")
def effort(spark, sf_dir):
    """S4"""
    rows = _uses(spark, sf_dir).withColumn("hours", scoring.base_hours(F.col("family"), F.col("usage"))).withColumn(
        "multiplier", scoring.file_multiplier(F.col("line_number"))
    )
    total = F.col("hours") * F.col("multiplier")
    return rows.select("family", "usage", "line_number", "hours", "multiplier", scoring.cost(total).alias("cost_eur"), scoring.complexity(total).alias("complexity"))


@query("vendors", f"WITH {FACTS}, {USE_SQL} SELECT usage, critical, fips, {_VENDOR} AS vendor, {sql_lookup(_VENDOR, {k: v[0] for k, v in t.VENDORS.items()})} AS about, count(*) AS findings FROM uses GROUP BY ALL")
def vendors(spark, sf_dir):
    """S6"""
    info = rule_tables.table(spark, [(k, v[0], v[1]) for k, v in t.VENDORS.items()], "vendor string, about string, best_for array<string>")
    counted = _uses(spark, sf_dir).groupBy("usage", "critical", "fips").agg(F.count("*").alias("findings"))
    return counted.withColumn("vendor", scoring.vendor(F.col("usage"), F.col("critical"), F.col("fips"))).join(F.broadcast(info), "vendor").drop("best_for")


REPLACEMENT_ROWS = [(f, i, use, new) for f, options in t.REPLACEMENTS.items() for i, (use, new) in enumerate(options)]


@query("replacements", f"""WITH {FACTS}, {sql_values(REPLACEMENT_ROWS, 'reps', 'family, rep_ord, purpose, replacement')}, used AS (SELECT family, count(*) AS findings FROM facts GROUP BY 1)
SELECT used.family, findings, CAST(rep_ord AS INTEGER) AS rep_ord, purpose, replacement, {sql_lookup('used.family', {k: v[0][1] for k, v in t.REPLACEMENTS.items()}, t.DEFAULT_REPLACEMENT)} AS headline
FROM used LEFT JOIN reps ON used.family = reps.family""")
def replacements(spark, sf_dir):
    """S5, J1"""
    options = rule_tables.table(spark, REPLACEMENT_ROWS, "family string, rep_ord int, purpose string, replacement string")
    used = facts(spark, sf_dir).groupBy(F.col("algorithm.family").alias("family")).agg(F.count("*").alias("findings"))
    return used.join(F.broadcast(options), "family", "left").withColumn("headline", scoring.first_replacement(F.col("family")))


# -- migration -------------------------------------------------------------------------

_PRIORITY = (
    "CASE " + " ".join(f"WHEN risk_level = {literal(s)} AND risk = {literal(r)} THEN {p}" for (s, r), p in t.PRIORITY.items()) + f" ELSE {t.DEFAULT_PRIORITY} END"
)
TASKS = f"""exposed AS (SELECT * FROM facts WHERE quantum_risk IN ('vulnerable', 'weakened')),
fam AS (SELECT family, count(*) AS instances, {sql_lookup('min(sev_ord)', SEV_NAME)} AS risk_level, CASE WHEN bool_or(quantum_risk = 'vulnerable') THEN 'vulnerable' ELSE 'weakened' END AS risk,
  count(DISTINCT file_path) AS affected_file_count FROM exposed GROUP BY family),
shown AS (SELECT family, string_agg(file_path, '|' ORDER BY file_path) AS affected_files FROM (SELECT DISTINCT family, file_path FROM exposed
  QUALIFY dense_rank() OVER (PARTITION BY family ORDER BY file_path) <= 20) GROUP BY family),
prio AS (SELECT *, {_PRIORITY} AS priority, 'library_call' AS usage FROM fam),
hours AS (SELECT *, {sql_lookup('priority', t.PHASE_OF_PRIORITY)} AS phase, round_even({_HOURS} * {sql_steps('affected_file_count', t.FILE_MULTIPLIER, t.MANY_FILES_MULTIPLIER, True)}, 1)::DOUBLE AS estimated_hours FROM prio),
tasks AS (SELECT format('MIG-{{:03d}}', row_number() OVER (ORDER BY family)) AS task_id, family AS from_algorithm,
  {sql_lookup('family', {k: v[0][1] for k, v in t.REPLACEMENTS.items()}, t.DEFAULT_REPLACEMENT)} AS to_algorithm, instances, risk_level, affected_file_count, CAST(priority AS INTEGER) AS priority,
  CAST(phase AS INTEGER) AS phase, estimated_hours, round_even(estimated_hours * 150.0, 2)::DOUBLE AS estimated_cost_eur, {sql_steps('estimated_hours', t.COMPLEXITY, t.MOST_COMPLEX, True)} AS complexity,
  CASE WHEN priority <= 2 THEN 'hybrid_transition' ELSE 'direct_replacement' END AS recommended_approach, 'OpenSource' AS vendor_recommendation, affected_files FROM hours JOIN shown USING (family))"""


@query("migration_tasks", f"WITH {FACTS}, {TASKS} SELECT * FROM tasks")
def migration_tasks(spark, sf_dir):
    """A7"""
    return migration.migration_tasks(facts(spark, sf_dir), shown_files=20).withColumn("affected_files", F.array_join("affected_files", "|")).drop("title")


PHASES = f"""phases AS (SELECT tasks.phase, p.name, count(*) AS tasks, sum(estimated_hours) AS total_hours, sum(estimated_cost_eur) AS total_cost_eur
  FROM tasks JOIN p ON tasks.phase = p.phase GROUP BY ALL)"""


@query("migration_phases", f"WITH {FACTS}, {TASKS}, {sql_values(t.PHASES, 'p', 'phase, name')}, {PHASES} SELECT * FROM phases")
def migration_phases(spark, sf_dir):
    """A8"""
    return migration.migration_phases(migration.migration_tasks(facts(spark, sf_dir)))


@query("migration_plan", f"""WITH {FACTS}, {TASKS}, x AS (SELECT count(*) AS total_tasks, count(DISTINCT phase) AS phases, sum(estimated_hours) AS h, sum(estimated_cost_eur) AS c,
  count(*) FILTER (priority = 1) AS critical_tasks, count(*) FILTER (priority = 2) AS high_priority_tasks FROM tasks)
SELECT total_tasks, phases, h AS total_estimated_hours, c AS total_estimated_cost_eur, critical_tasks, high_priority_tasks, CAST(greatest(1, floor(h / 160) + 1) AS INTEGER) AS overall_timeline_months,
  concat(total_tasks, ' tasks in ', phases, ' phases: ', format('{{:,}}', CAST(round_even(h, 0) AS BIGINT)), ' hours, ', format('{{:,}}', CAST(round_even(c, 0) AS BIGINT)), ' EUR, ',
    CAST(greatest(1, floor(h / 160) + 1) AS INTEGER), ' months') AS plan_text FROM x""")
def migration_plan(spark, sf_dir):
    """A9"""
    return migration.migration_plan(migration.migration_tasks(facts(spark, sf_dir)))


# -- comparison -------------------------------------------------------------------------


def _two_scans(spark, sf_dir):
    both = facts(spark, sf_dir)
    return both.where("scan_id = '1996'"), both.where("scan_id = '1998'")


KEYED = """keyed AS (SELECT scan_id, rule_id, file_path, name AS algorithm_name, severity, quantum_risk, line_number, message FROM facts WHERE scan_id IN ('1996', '1998')
  QUALIFY row_number() OVER (PARTITION BY scan_id, rule_id, file_path, name ORDER BY ord DESC) = 1),
a AS (SELECT * FROM keyed WHERE scan_id = '1996'), b AS (SELECT * FROM keyed WHERE scan_id = '1998')"""
KEY_LIST = "rule_id, file_path, algorithm_name"


@query("new_findings", f"WITH {FACTS}, {KEYED} SELECT {KEY_LIST}, severity, quantum_risk, line_number, message FROM b ANTI JOIN a USING ({KEY_LIST})")
def new_findings(spark, sf_dir):
    """J3, O2"""
    return compare.new_findings(*_two_scans(spark, sf_dir)).drop("ord")


@query("resolved_findings", f"WITH {FACTS}, {KEYED} SELECT {KEY_LIST}, severity, quantum_risk, line_number, message FROM a ANTI JOIN b USING ({KEY_LIST})")
def resolved_findings(spark, sf_dir):
    """J3"""
    return compare.resolved_findings(*_two_scans(spark, sf_dir)).drop("ord")


@query("unchanged_findings", f"WITH {FACTS}, {KEYED} SELECT {KEY_LIST} FROM a SEMI JOIN b USING ({KEY_LIST})")
def unchanged_findings(spark, sf_dir):
    """J4, O2"""
    return compare.unchanged_keys(*_two_scans(spark, sf_dir))


STATUS = f"""status AS (SELECT {KEY_LIST}, a.severity AS old_severity, b.severity AS new_severity, a.quantum_risk AS old_risk, b.quantum_risk AS new_risk,
  CASE WHEN a.severity IS NULL THEN 'new' WHEN b.severity IS NULL THEN 'resolved' WHEN a.severity <> b.severity OR a.quantum_risk <> b.quantum_risk THEN 'changed' ELSE 'unchanged' END AS status
  FROM a FULL JOIN b USING ({KEY_LIST}))"""


@query("finding_status", f"WITH {FACTS}, {KEYED}, {STATUS} SELECT * FROM status")
def finding_status(spark, sf_dir):
    """J5"""
    return compare.finding_status(*_two_scans(spark, sf_dir))


@query("scan_comparison", f"""WITH {FACTS}, {KEYED}, {STATUS}, n AS (SELECT count(*) FILTER (status = 'new') AS new_count, count(*) FILTER (status = 'resolved') AS resolved_count,
  count(*) FILTER (status IN ('changed', 'unchanged')) AS unchanged_count FROM status),
s AS (SELECT scan_id, round_even(raw, 1)::DOUBLE AS score, {sql_grade('raw')} AS grade FROM (SELECT scan_id, {SUMMARY} FROM facts GROUP BY scan_id)),
j AS (SELECT n.*, sa.score AS score_a, sa.grade AS grade_a, sb.score AS score_b, sb.grade AS grade_b, round_even(sb.score - sa.score, 1)::DOUBLE AS score_change
  FROM n, s sa, s sb WHERE sa.scan_id = '1996' AND sb.scan_id = '1998')
SELECT *, concat(CASE WHEN score_change > 0 THEN concat('Score improved by ', score_change, ' points') WHEN score_change < 0 THEN concat('Score decreased by ', abs(score_change), ' points') ELSE 'Score unchanged' END,
  '. (', grade_a, ' -> ', grade_b, ')', CASE WHEN new_count > 0 THEN concat('. ', new_count, ' new findings') ELSE '' END,
  CASE WHEN resolved_count > 0 THEN concat('. ', resolved_count, ' resolved findings') ELSE '' END, '. ', unchanged_count, ' unchanged') AS summary FROM j""")
def scan_comparison(spark, sf_dir):
    """S9, J3, J4"""
    a, b = _two_scans(spark, sf_dir)
    return compare.compare_scans(a, b, aggregate.summarise(a), aggregate.summarise(b))


def _scans(spark, sf_dir):
    o = F.col("o_custkey")
    return corpus.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("scan_id"), F.concat(F.lit("repo"), o % 300).alias("target"),
        (F.col("o_orderdate") + F.make_interval(secs=F.col("o_orderkey"))).alias("ts"), F.round(F.col("o_totalprice") % 101, 1).alias("score"),
    )


SCANS_SQL = """scans AS (SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, concat('repo', o_custkey % 300) AS target, o_orderdate + to_seconds(o_orderkey) AS ts,
  round(o_totalprice % 101, 1)::DOUBLE AS score FROM orders)"""


@query("score_steps", f"WITH {SCANS_SQL} SELECT scan_id, target, score, round(score - lag(score) OVER (PARTITION BY target ORDER BY ts), 6) AS score_delta FROM scans")
def score_steps(spark, sf_dir):
    """W7"""
    return compare.score_steps(_scans(spark, sf_dir)).select("scan_id", "target", "score", F.round("score_delta", 6).alias("score_delta"))


@query("score_trend", f"""WITH {SCANS_SQL}, d AS (SELECT *, epoch(ts) / 86400.0::DOUBLE AS day, score - lag(score) OVER (PARTITION BY target ORDER BY ts) AS delta FROM scans),
g AS (SELECT target, count(*) AS scans, avg(delta) AS m, regr_slope(score, day) AS slope, regr_intercept(score, day) AS intercept, arg_max(score, ts) AS last FROM d GROUP BY target)
SELECT target, scans, round(coalesce(m, 0), 6)::DOUBLE AS average_improvement_per_scan, CASE WHEN m > 0 THEN 'improving' WHEN m < 0 THEN 'degrading' ELSE 'stable' END AS score_trend,
  CASE WHEN last < 90 AND slope > 0 AND (90 - intercept) / slope < 2.0e6 THEN strftime(DATE '1970-01-01' + CAST(ceil((90 - intercept) / slope) AS INTEGER), '%Y-%m-%d') END AS projected_compliance_date FROM g""")
def score_trend(spark, sf_dir):
    """W7"""
    return compare.score_trend(_scans(spark, sf_dir)).withColumn("average_improvement_per_scan", F.round("average_improvement_per_scan", 6))


# -- reports --------------------------------------------------------------------------


@query("finding_rows", f"""WITH {FACTS} SELECT ord.a AS order_key, ord.c AS part_key, severity, quantum_risk, name AS algorithm, concat(file_path, ':', line_number) AS place,
  string_split(file_path, '/')[-1] AS file_name, message, CASE WHEN recommendation = '' THEN '—' ELSE recommendation END AS recommendation FROM facts""")
def finding_rows(spark, sf_dir):
    """R11"""
    return report.finding_rows(facts(spark, sf_dir)).withColumn("order_key", F.col("ord.a")).withColumn("part_key", F.col("ord.c")).drop("ord", "sev_ord")


@query("compliance_rows", f"""WITH {FACTS}, {REQS}, {REFS} SELECT scan_id_files.*, count(*) AS n FROM (SELECT name AS algorithm, framework, requirement_id, told AS description, status,
  CASE status WHEN 'non_compliant' THEN 'Non Compliant' ELSE 'Action Required' END AS status_display, deadline, regexp_extract(concat(file_path, ':', line_number), '^[^/]+', 0) AS top FROM refs) AS scan_id_files GROUP BY ALL""")
def compliance_rows(spark, sf_dir):
    """R11"""
    rows = report.compliance_rows(facts(spark, sf_dir)).withColumn("top", F.regexp_extract("place", "^[^/]+", 0))
    return rows.groupBy("algorithm", "framework", "requirement_id", "description", "status", "status_display", "deadline", "top").agg(F.count("*").alias("n"))


@query("unique_recommendations", f"""WITH {FACTS} SELECT name AS algorithm, recommendation, coalesce(nullif(array_to_string(replacements, ', '), ''), '—') AS replacements FROM facts
WHERE recommendation <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY sev_ord, ord) = 1""")
def unique_recommendations(spark, sf_dir):
    """W3"""
    return report.unique_recommendations(facts(spark, sf_dir)).select("algorithm", "recommendation", "replacements")


@query("top_findings", f"""WITH {FACTS} SELECT rule_id, severity, file_path, line_number, CAST(row_number() OVER (ORDER BY sev_ord, ord) AS INTEGER) AS position,
  greatest((SELECT count(*) FROM facts) - 5, 0) AS left_out FROM facts ORDER BY sev_ord, ord LIMIT 5""")
def top_findings(spark, sf_dir):
    """W4"""
    return report.top_findings(facts(spark, sf_dir)).select("rule_id", "severity", "location.file_path", "location.line_number", "position", "left_out")


SARIF = f"""firsts AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY ord) = 1),
indexed AS (SELECT *, CAST(row_number() OVER (ORDER BY ord) - 1 AS INTEGER) AS rule_index FROM firsts)"""


@query("sarif_rules", f"""WITH {FACTS}, {SARIF} SELECT rule_index, rule_id AS id, message AS short_text, concat(message, '. ', recommendation) AS full_text,
  concat('**Algorithm:** ', name, chr(10), chr(10), '**Quantum Risk:** ', quantum_risk, chr(10), chr(10), '**Recommendation:** ', recommendation) AS markdown,
  {sql_lookup('severity', {k: v[1] for k, v in t.SARIF_SEVERITY.items()})} AS security_severity, concat('security|cryptography|post-quantum|', quantum_risk) AS tags FROM indexed""")
def sarif_rules(spark, sf_dir):
    """P10"""
    return finding_sources.sarif_rules(facts(spark, sf_dir)).select(
        "rule_index", "id", F.col("shortDescription.text").alias("short_text"), F.col("fullDescription.text").alias("full_text"), "help.markdown",
        "properties.security_severity", F.array_join("properties.tags", "|").alias("tags"),
    )


@query("sarif_results", f"""WITH {FACTS}, {SARIF} SELECT f.ord.a AS order_key, f.ord.c AS part_key, f.rule_id, i.rule_index, {sql_lookup('f.severity', {k: v[0] for k, v in t.SARIF_SEVERITY.items()})} AS level,
  concat(f.message, '. Algorithm: ', f.name, ' (Quantum Risk: ', f.quantum_risk, '). ', f.recommendation) AS message, f.file_path AS uri, f.line_number AS start_line, f.line_content AS snippet
FROM facts f JOIN indexed i USING (rule_id)""")
def sarif_results(spark, sf_dir):
    """P10"""
    return finding_sources.sarif_results(facts(spark, sf_dir)).select(
        F.col("ord.a").alias("order_key"), F.col("ord.c").alias("part_key"), F.col("ruleId").alias("rule_id"), F.col("ruleIndex").alias("rule_index"), "level",
        F.col("message.text").alias("message"), "region.uri", F.col("region.startLine").alias("start_line"), "region.snippet",
    )


@query("findings_json", f"""WITH {FACTS} SELECT ord.a AS order_key, ord.c AS part_key, rule_id, name, key_size, line_number, len(replacements) AS replacements FROM facts""")
def findings_json(spark, sf_dir):
    """Written as JSON text and read back under the fixed schema"""
    from cipherledger import schema

    found = facts(spark, sf_dir).drop("scan_id")
    text_rows = found.select(F.to_json(F.struct(*found.columns)).alias("json"))
    back = text_rows.select(F.from_json("json", schema.FINDING).alias("f")).select("f.*")
    return back.select(
        F.col("ord.a").alias("order_key"), F.col("ord.c").alias("part_key"), "rule_id", "algorithm.name", "algorithm.key_size", "location.line_number",
        F.size("algorithm.pqc_replacements").cast("long").alias("replacements"),
    )


# -- certificates, endpoints, calls --------------------------------------------------------

_RSA = "CASE " + " ".join(f"WHEN key_size <= {n} THEN {literal(k)}" for n, k in endpoint_rules.RSA_KEY_CLASSES) + " ELSE 'RSA-generic' END"
_HASH = "CASE " + " ".join(f"WHEN contains(lower(sig_hash), {literal(k)}) THEN {literal(v)}" for k, v in endpoint_rules.SIGNATURE_HASHES.items()) + " END"
CERT_SQL = f"""WITH {corpus.CERTIFICATES_SQL}, {ALGS},
told AS (SELECT *, concat('Certificate subject=', coalesce(subject_cn, '<unknown subject>'), ', expires=', strftime(not_after, '%Y-%m-%d')) AS line_content FROM certs),
sides AS (SELECT path, cert_index, line_content, 'CERT-PK-' AS prefix, CASE key_type WHEN 'RSA' THEN {_RSA} WHEN 'EC' THEN coalesce({sql_lookup('curve', endpoint_rules.CURVES)}, 'ECC-generic') WHEN 'DSA' THEN 'DSA-generic' END AS k FROM told
  UNION ALL SELECT path, cert_index, line_content, 'CERT-SIG-', coalesce({sql_lookup('sig_oid', endpoint_rules.SIGNATURE_OIDS)}, {_HASH}) FROM told)
SELECT path, CAST(cert_index + 1 AS INTEGER) AS line_number, concat(prefix, k) AS rule_id, coalesce({sql_lookup('k', endpoint_rules.CERTIFICATE_SEVERITY)}, 'medium') AS severity,
  algorithm_risk AS quantum_risk, k AS algorithm, family, algs.key_size, line_content FROM sides JOIN algs ON k = name"""


@query("certificates", CERT_SQL)
def certificates(spark, sf_dir):
    """D17"""
    return flat(detect_endpoints.detect_certificates(corpus.certificates(spark, sf_dir))).drop("before", "after")


def _branch(where, rule_id, severity, name, family, detail, key_size="CAST(NULL AS INTEGER)"):
    return f"SELECT concat(host, ':', port) AS path, {rule_id} AS rule_id, {severity} AS severity, {name} AS algorithm, {family} AS family, {key_size} AS key_size, {detail} AS line_content FROM endpoints WHERE {where}"


_SUITE = "concat('Cipher: ', cipher)"
TLS_ENDPOINT_SQL = f"WITH {corpus.ENDPOINTS_SQL} " + " UNION ALL ".join(
    [_branch(f"tls_version = {literal(v)}", literal(r), literal(s), literal(v), "'DH'", literal(f"Supports {v}")) for v, r, s in endpoint_rules.OLD_TLS_VERSIONS]
    + [_branch(f"contains(upper(cipher), {literal(w)})", literal(f"NET-CIPHER-{n.upper()}"), literal(s), literal(n), literal(f), _SUITE) for w, s, f, n in endpoint_rules.WEAK_SUITE_WORDS]
    + [
        _branch("NOT (contains(cipher, 'DHE') OR contains(cipher, 'ECDH'))", "'NET-NO-PFS'", "'medium'", "'No-PFS'", "'RSA'", _SUITE),
        _branch("contains(cipher, 'RSA') AND NOT contains(cipher, 'DHE')", "'NET-RSA-KEX'", "'high'", "'RSA-KeyExchange'", "'RSA'", _SUITE),
        _branch("key_type = 'RSA'", "'NET-CERT-RSA'", "CASE WHEN key_size < 2048 THEN 'critical' ELSE 'high' END", "concat('RSA-', key_size)", "'RSA'", "concat('Certificate: RSA-', key_size)", "key_size"),
        _branch("key_type = 'EC'", "'NET-CERT-ECC'", "'high'", "concat('ECC-', curve)", "'ECC'", "concat('Certificate: ECC-', curve)", "key_size"),
        _branch("key_type = 'DSA'", "'NET-CERT-DSA'", "'critical'", "'DSA'", "'DSA'", "'Certificate: DSA'"),
        _branch("lower(sig_hash) IN ('md5', 'sha1')", "concat('NET-CERT-SIG-', upper(sig_hash))", "'critical'", "upper(sig_hash)", "CASE lower(sig_hash) WHEN 'md5' THEN 'MD5' ELSE 'SHA-1' END", "concat('Signature: ', sig_hash)"),
    ]
)


@query("tls_endpoints", TLS_ENDPOINT_SQL)
def tls_endpoints(spark, sf_dir):
    """D18"""
    return flat(detect_endpoints.detect_tls_endpoints(corpus.endpoints(spark, sf_dir))).drop("before", "after", "quantum_risk", "line_number")


OFFERED = f"""WITH {corpus.SSH_OFFERS_SQL}, {sql_values(endpoint_rules.SSH_OFFERS, 'weak', 'list, offered, severity, name, family, quantum_risk')},
lists AS (SELECT host, port, 'KEX' AS list, kex AS names FROM offers UNION ALL SELECT host, port, 'HOSTKEY', hostkey FROM offers
  UNION ALL SELECT host, port, 'CIPHER', list_distinct(list_concat(cipher_c2s, cipher_s2c)) FROM offers UNION ALL SELECT host, port, 'MAC', list_distinct(list_concat(mac_c2s, mac_s2c)) FROM offers),
each AS (SELECT concat(host, ':', port) AS path, list, unnest(names) AS offered FROM lists)"""


SSH_ENDPOINT_SQL = f"""{OFFERED} SELECT path, concat('NET-SSH-', list, '-', replace(upper(name), '-', '')) AS rule_id, severity, quantum_risk, name AS algorithm, family,
  concat(CASE list WHEN 'HOSTKEY' THEN 'HostKey' WHEN 'CIPHER' THEN 'Cipher' ELSE list END, ': ', offered) AS line_content FROM each JOIN weak USING (list, offered)"""


@query("ssh_endpoints", SSH_ENDPOINT_SQL)
def ssh_endpoints(spark, sf_dir):
    """D19"""
    return flat(detect_endpoints.detect_ssh_endpoints(corpus.ssh_offers(spark, sf_dir))).drop("before", "after", "key_size", "line_number")


@query("offered_names", f"{OFFERED} SELECT path, list, offered FROM each")
def offered_names(spark, sf_dir):
    """O3"""
    return detect_endpoints.offered_names(corpus.ssh_offers(spark, sf_dir)).select("path", "list", "offered")


SUITES = sql_values(endpoint_rules.CIPHER_SUITES, "suites", "cipher, key_exchange, authentication, bulk_cipher, mac, pfs, quantum_risk, risk_score")


@query("cipher_suites", f"""WITH {corpus.ENDPOINTS_SQL}, {SUITES} SELECT host, e.cipher, key_exchange, authentication, bulk_cipher, mac, pfs, quantum_risk, risk_score,
  contains(upper(e.cipher), 'DHE') AS offers_pfs, FALSE AS quantum_safe FROM endpoints e LEFT JOIN suites s ON e.cipher = s.cipher""")
def cipher_suites(spark, sf_dir):
    """D20, J1"""
    return detect_endpoints.classify_suites(corpus.endpoints(spark, sf_dir).select("host", "cipher"))


DANE_SQL = """SELECT concat('c', c_custkey, '.example.org') AS path, 'NET-DNS-NO-DANE' AS rule_id, 'info' AS severity, 'DANE-Missing' AS algorithm FROM customer
WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)"""


def _domains(spark, sf_dir):
    def domain(column):
        return F.concat(F.lit("c"), column, F.lit(".example.org")).alias("domain")

    domains = corpus.read(spark, sf_dir, "customer").select(domain(F.col("c_custkey")))
    records = corpus.read(spark, sf_dir, "supplier").select(domain(F.col("s_suppkey")))
    return domains, records


@query("missing_dane", DANE_SQL)
def missing_dane(spark, sf_dir):
    """D21"""
    return flat(detect_endpoints.detect_missing_dane(*_domains(spark, sf_dir))).select("path", "rule_id", "severity", "algorithm")


_GENERATES = "contains(func_name, 'generate_private_key')"
CALL_SQL = f"""WITH {corpus.CALLS_SQL}, k AS (SELECT *, CASE WHEN {_GENERATES} AND contains(lower(func_name), 'rsa') THEN 'rsa' WHEN {_GENERATES} AND contains(lower(func_name), 'ec') THEN 'ec'
  WHEN func_name IN ('hashlib.md5', 'md5') THEN 'md5' WHEN func_name IN ('hashlib.sha1', 'sha1') THEN 'sha1' WHEN func_name IN ({', '.join(literal(f) for f in endpoint_rules.WEAK_RANDOM_CALLS)}) THEN 'random' END AS kind FROM calls)
SELECT path, line AS line_number, CASE kind WHEN 'rsa' THEN CASE WHEN key_size IS NULL THEN 'AST-PY-RSA-GEN' ELSE concat('AST-PY-RSA-', key_size) END WHEN 'ec' THEN 'AST-PY-ECC-GEN'
  WHEN 'md5' THEN 'AST-PY-MD5' WHEN 'sha1' THEN 'AST-PY-SHA1' ELSE 'AST-PY-WEAK-RANDOM' END AS rule_id,
  CASE WHEN kind = 'random' THEN 'medium' WHEN kind = 'rsa' AND key_size < 2048 THEN 'critical' ELSE 'high' END AS severity, CASE kind WHEN 'random' THEN 'unknown' ELSE 'vulnerable' END AS quantum_risk,
  CASE kind WHEN 'rsa' THEN CASE WHEN key_size IS NULL THEN 'RSA-generic' ELSE concat('RSA-', key_size) END WHEN 'ec' THEN 'ECC-generic' WHEN 'md5' THEN 'MD5' WHEN 'sha1' THEN 'SHA-1' ELSE 'WeakRandom' END AS algorithm,
  CASE WHEN kind = 'rsa' THEN key_size END AS key_size, trim(line_content) AS line_content FROM k WHERE kind IS NOT NULL"""


@query("call_sites", CALL_SQL)
def call_sites(spark, sf_dir):
    """D22"""
    return flat(detect_endpoints.detect_calls(corpus.calls(spark, sf_dir))).drop("before", "after", "family")


TARGET_PORTS = ["22", "8443", "https", "", "443x"]


@query("target_ports", f"""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN concat('h', c_custkey) ELSE concat('h', c_custkey, ':', {sql_pick('c_custkey', TARGET_PORTS)}) END AS target FROM customer)
SELECT target, CASE WHEN regexp_matches(target, ':[0-9]+$') THEN string_split(target, ':')[1] ELSE target END AS host,
  CASE WHEN regexp_matches(target, ':[0-9]+$') THEN CAST(string_split(target, ':')[2] AS INTEGER) ELSE 443 END AS port FROM t""")
def target_ports(spark, sf_dir):
    """D23"""
    k = F.col("c_custkey")
    target = F.when(k % 7 == 0, F.concat(F.lit("h"), k)).otherwise(F.concat(F.lit("h"), k, F.lit(":"), corpus.pick(k, TARGET_PORTS)))
    rows = corpus.read(spark, sf_dir, "customer").select(target.alias("target"))
    host, port = detect_endpoints.host_and_port(F.col("target"))
    return rows.select("target", host.alias("host"), port.alias("port"))


# -- whole scans -----------------------------------------------------------------------------


def _scan_rows(found):
    return found.select(
        F.col("location.file_path").alias("path"), "location.line_number", "rule_id", "severity", "quantum_risk",
        F.round("confidence", 6).alias("confidence"), F.size("compliance_refs").cast("long").alias("refs"), "scanner_type",
    )


def _scan_sql(parts: list[tuple[str, str]], where: str = "TRUE") -> str:
    """Detectors' SQL put together, with confidence, duplicates and requirement counts."""
    union = " UNION ALL ".join(f"SELECT *, {literal(scanner)} AS scanner_type FROM ({sql})" for scanner, sql in parts)
    return f"""WITH facts AS (SELECT path AS file_path, concat(before, ' ', after) AS around, algorithm AS name, * EXCLUDE (path) FROM ({union})),
{CONFIDENCE}, {REQS}, kept AS (SELECT * FROM adjusted WHERE confidence >= CAST(0.2 AS DOUBLE) AND {where}
  QUALIFY row_number() OVER (PARTITION BY rule_id, file_path, line_number ORDER BY line_content) = 1)
SELECT file_path AS path, line_number, rule_id, severity, quantum_risk, round(confidence, 6) AS confidence, scanner_type,
  count(requirement_ord) AS refs FROM kept LEFT JOIN reqs ON {' OR '.join(_REF_CONDITIONS)} GROUP BY ALL"""


@query("code_scan", _scan_sql([("source", SOURCE_SQL), ("secrets", SECRETS_SQL)]))
def code_scan(spark, sf_dir):
    """Source and secrets in one pass over the files"""
    return _scan_rows(scan_plan.scan(corpus.CODE.files(spark, sf_dir), detectors=["source", "secrets"]))


@query("quick_profile", _scan_sql([("source", SOURCE_SQL)], "severity IN ('critical', 'high')"))
def quick_profile(spark, sf_dir):
    """P9, R7"""
    return _scan_rows(scan_plan.scan(corpus.CODE.files(spark, sf_dir), profile="quick"))


# documents of a remainder make one long file, in order of their ids
LONG_FILES = 40
LONG_SUFFIXES = [".py", ".java", ".js", ".go", ".php", ".ini", ".rb", ".cs"]
LONG_SQL = f"""
made AS (SELECT concat('long/f', doc_id % {LONG_FILES}, {sql_pick('doc_id', LONG_SUFFIXES)}) AS path,
  concat(string_agg({corpus.CODE.content_sql()}, chr(10) ORDER BY doc_id), chr(10)) AS content
  FROM documents WHERE text IS NOT NULL GROUP BY 1),
{corpus.FILES_SQL}"""


@query("long_files", _scan_sql([(name, sql.replace(corpus.CODE.sql(), LONG_SQL)) for name, sql in (("source", SOURCE_SQL), ("secrets", SECRETS_SQL))]))
def long_files(spark, sf_dir):
    """Documents written as few long files, read by byte ranges and scanned in pieces"""
    group = F.col("doc_id") % LONG_FILES
    folder = f"{stored.shared_folder(spark)}/long-{uuid.uuid4().hex}"
    rows = corpus.read(spark, sf_dir, "documents").where("text IS NOT NULL").select(group.alias("f"), "doc_id", corpus.CODE.content().alias("content"))
    rows.repartition(LONG_FILES, "f").sortWithinPartitions("f", "doc_id").select("f", "content").write.partitionBy("f").text(folder)
    number = F.regexp_extract("path", "/f=([0-9]+)/", 1).cast("int")
    path = F.concat(F.lit("long/f"), number, corpus.pick(number, LONG_SUFFIXES))
    pieces = read_pieces(spark, [folder], path=path, piece_bytes=20_000)
    return _scan_rows(scan_long_files(pieces, detectors=["source", "secrets"]))


@query("document_secrets", f"""WITH facts AS (SELECT path AS file_path, concat(before, ' ', after) AS around, * EXCLUDE (path) FROM (
  WITH {corpus.DOCUMENTS.sql()}, {SECRET_RULES} SELECT path, CAST(n AS INTEGER) AS line_number, rule_id, severity, quantum_risk,
    trim(line, ' ' || chr(9)) AS line_content, {sql_context(3)} FROM lines, rules WHERE regexp_matches(line, pattern))), {CONFIDENCE}
SELECT file_path AS path, line_number, rule_id, severity, quantum_risk, round(confidence, 6) AS confidence FROM adjusted
WHERE confidence >= CAST(0.2 AS DOUBLE)""")
def document_secrets(spark, sf_dir):
    """L1, D8, L2, E1, W1, R7 over the documents as they are"""
    found = scan_plan.scan(corpus.DOCUMENTS.files(spark, sf_dir), detectors=["secrets"])
    return _scan_rows(found).drop("refs", "scanner_type")


# all text corpora as one set of files: every detector may read any of them
TEXTS = [
    corpus.CODE, corpus.SSH, corpus.TLS, corpus.PYTHON_MANIFESTS, corpus.POM, corpus.GO_MOD, corpus.TERRAFORM, corpus.CLOUDFORMATION,
    corpus.ANSIBLE, corpus.DOCKER, corpus.KUBERNETES, corpus.BINARY_TEXT,
]
ALL_SQL = "\nmade AS (" + " UNION ALL ".join(c.made_sql() for c in TEXTS) + f"),\n{corpus.FILES_SQL}"


def _over_all(source: corpus.Corpus, sql: str) -> str:
    return sql.replace(source.sql(), ALL_SQL)


_WIDE = "path, line_number, rule_id, severity, quantum_risk, algorithm, family, key_size, line_content, before, after"
_BARE = "'' AS before, '' AS after"
_NO_SIZE = "CAST(NULL AS INTEGER) AS key_size"
# scanner, base confidence, SQL with the columns of _WIDE; compiled files come as texts here, so their positions count characters
EVERY_PART = [
    ("source", 1.0, _over_all(corpus.CODE, SOURCE_SQL)),
    ("source", endpoint_rules.CALL_CONFIDENCE, f"SELECT path, line_number, rule_id, severity, quantum_risk, algorithm, CASE algorithm WHEN 'SHA-1' THEN 'SHA-1' WHEN 'WeakRandom' THEN 'Random' ELSE split_part(algorithm, '-', 1) END AS family, key_size, line_content, {_BARE} FROM ({CALL_SQL})"),
    ("secrets", 1.0, _over_all(corpus.CODE, SECRETS_SQL)),
    ("config", 1.0, _over_all(corpus.SSH, SSH_SQL)),
    ("config", 1.0, _over_all(corpus.TLS, TLS_SQL)),
    ("dependency", config_rules.MANIFEST_CONFIDENCE, _over_all(corpus.PYTHON_MANIFESTS, PYTHON_SQL)),
    ("dependency", config_rules.MANIFEST_CONFIDENCE, _over_all(corpus.POM, JAVA_SQL)),
    ("dependency", config_rules.MANIFEST_CONFIDENCE, _over_all(corpus.GO_MOD, GO_SQL)),
    ("iac", 1.0, _over_all(corpus.TERRAFORM, document_sql(corpus.TERRAFORM, "suffix = '.tf'", text_rules.TERRAFORM))),
    ("iac", 1.0, _over_all(corpus.CLOUDFORMATION, document_sql(corpus.CLOUDFORMATION, CFN, text_rules.CLOUDFORMATION))),
    ("iac", 1.0, _over_all(corpus.ANSIBLE, document_sql(corpus.ANSIBLE, ANS, text_rules.ANSIBLE))),
    ("container", 1.0, _over_all(corpus.DOCKER, document_sql(corpus.DOCKER, DOCKER, text_rules.DOCKERFILE))),
    ("container", 1.0, _over_all(corpus.KUBERNETES, document_sql(corpus.KUBERNETES, K8S, text_rules.KUBERNETES))),
    ("binary", 1.0, f"SELECT * EXCLUDE (algorithm, line_content), algorithm, algorithm AS family, {_NO_SIZE}, line_content, {_BARE} FROM ({STRINGS_SQL.replace('strlen(g)', 'length(g)')})"),
    ("binary", 1.0, f"SELECT * EXCLUDE (algorithm, line_content), algorithm, algorithm AS family, {_NO_SIZE}, line_content, {_BARE} FROM ({SYMBOLS_SQL})"),
    ("certificate", 1.0, f"SELECT *, {_BARE} FROM ({CERT_SQL})"),
    ("network", 1.0, f"SELECT *, 0 AS line_number, 'vulnerable' AS quantum_risk, {_BARE} FROM ({TLS_ENDPOINT_SQL})"),
    ("network", 1.0, f"SELECT *, 0 AS line_number, {_NO_SIZE}, {_BARE} FROM ({SSH_ENDPOINT_SQL})"),
    ("network", 1.0, f"SELECT *, 0 AS line_number, 'unknown' AS quantum_risk, 'Unknown' AS family, {_NO_SIZE}, 'DNS' AS line_content, {_BARE} FROM ({DANE_SQL})"),
]


def _every_sql(scanners: list[str]) -> str:
    """A whole scan by some detectors: each one's SQL over all files, then confidence, duplicates and requirement counts."""
    union = " UNION ALL ".join(
        f"SELECT {_WIDE}, CAST({base!r} AS DOUBLE) AS base, {literal(scanner)} AS scanner_type FROM ({sql})"
        for scanner, base, sql in EVERY_PART if scanner in scanners
    )
    confidence_sql = CONFIDENCE.replace("CAST(1.0 AS DOUBLE) - CAST(0.3 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END", "base - CAST(0.3 AS DOUBLE) ELSE base END")
    return f"""WITH facts AS (SELECT path AS file_path, concat(before, ' ', after) AS around, algorithm AS name, * EXCLUDE (path) FROM ({union})),
{confidence_sql}, {REQS}, kept AS (SELECT *, row_number() OVER () AS id FROM adjusted WHERE confidence >= CAST(0.2 AS DOUBLE)
  QUALIFY row_number() OVER (PARTITION BY rule_id, file_path, line_number ORDER BY line_content) = 1)
SELECT file_path AS path, line_number, rule_id, severity, quantum_risk, round(confidence, 6) AS confidence, scanner_type,
  count(requirement_ord) AS refs FROM kept LEFT JOIN reqs ON {' OR '.join(_REF_CONDITIONS)} GROUP BY id, 1, 2, 3, 4, 5, 6, 7"""


def _whole_scan(spark, sf_dir, **options):
    files = corpus.files_of(TEXTS, spark, sf_dir)
    domains, records = _domains(spark, sf_dir)
    return scan_plan.scan(
        files, certificates=corpus.certificates(spark, sf_dir), endpoints=corpus.endpoints(spark, sf_dir),
        ssh_offers=corpus.ssh_offers(spark, sf_dir), domains=domains, tlsa_records=records, calls=corpus.calls(spark, sf_dir), **options,
    )


@query("every_detector", f"""SELECT scanner_type, severity, count(*) AS findings, count(DISTINCT path) AS places, CAST(sum(refs) AS BIGINT) AS refs
FROM ({_every_sql(dimensions.DETECTORS)}) GROUP BY ALL""")
def every_detector(spark, sf_dir):
    """O1: all corpora, certificates, endpoints, domains and calls in one scan by all detectors, counted"""
    found = _whole_scan(spark, sf_dir)
    return found.groupBy("scanner_type", "severity").agg(
        F.count("*").alias("findings"), F.countDistinct("location.file_path").alias("places"),
        F.sum(F.size("compliance_refs")).cast("long").alias("refs"),
    )


def _profile(name: str):
    def run(spark, sf_dir):
        return _scan_rows(_whole_scan(spark, sf_dir, profile=name))

    run.__doc__ = f"P9, O1: the preset {name} over everything that can be scanned"
    return query(f"{name}_profile", _every_sql(dimensions.PROFILES[name][0]))(run)


standard_profile, deep_profile, paranoid_profile = (_profile(name) for name in ("standard", "deep", "paranoid"))


@query("stored_findings", f"WITH {FACTS}, {KEYED}, {STATUS} SELECT * FROM status")
def stored_findings(spark, sf_dir):
    """Two scans stored in buckets, read back and compared bucket by bucket"""
    before, after = _stored_two(spark, sf_dir)
    return compare.key_status(before.keys, after.keys)


def _stored_two(spark, sf_dir):
    folder = f"{stored.shared_folder(spark)}/scans-{uuid.uuid4().hex}"
    return [
        write_scan(found.drop("scan_id"), f"{folder}/{year}", [sf_dir], datetime(year, 12, 31), str(year), buckets=16)
        for year, found in zip((1996, 1998), _two_scans(spark, sf_dir), strict=True)
    ]


@query("stored_summaries", f"""WITH {FACTS} SELECT scan_id, total_findings, files_scanned, round_even(raw, 1)::DOUBLE AS score, {sql_grade('raw')} AS grade, pqc_readiness_pct
FROM (SELECT scan_id, {SUMMARY} FROM facts WHERE scan_id IN ('1996', '1998') GROUP BY scan_id)""")
def stored_summaries(spark, sf_dir):
    """Summaries of stored scans, from their states"""
    return post.union_all([s.summary for s in _stored_two(spark, sf_dir)]).select(
        "scan_id", "total_findings", "files_scanned", "score", "grade", "pqc_readiness_pct"
    )


@query("updated_summary", f"""WITH {FACTS} SELECT total_findings, files_scanned, round_even(raw, 1)::DOUBLE AS score, {sql_grade('raw')} AS grade, pqc_readiness_pct
FROM (SELECT {SUMMARY} FROM facts WHERE scan_id = '1998')""")
def updated_summary(spark, sf_dir):
    """A1 to A3: the earlier scan's state carried on by what came and went, against a count of the later scan"""
    before, after = _two_scans(spark, sf_dir)

    def narrow(found):
        return found.select("location", "severity", "quantum_risk", "rule_id")

    before, after = narrow(before), narrow(after)
    state = aggregate.updated_state(aggregate.summary_state(before), after.exceptAll(before), before.exceptAll(after))
    return aggregate.summary_of_state(state).select("total_findings", "files_scanned", "score", "grade", "pqc_readiness_pct")


@query("inventory_locations", f"WITH {FACTS} SELECT DISTINCT name, file_path FROM facts")
def inventory_locations(spark, sf_dir):
    """A5: every file of every asset"""
    return aggregate.inventory_locations(facts(spark, sf_dir))


@query("migration_files", f"WITH {FACTS} SELECT DISTINCT family AS from_algorithm, file_path FROM facts WHERE quantum_risk IN ('vulnerable', 'weakened')")
def migration_files(spark, sf_dir):
    """Every file of every task"""
    return migration.migration_files(facts(spark, sf_dir))


@query("gap_requirements", f"""WITH {FACTS}, {REQS}, {REFS} SELECT DISTINCT framework, concat(requirement_id, ': ', told) AS gap
  FROM refs WHERE status = 'non_compliant'""")
def gap_requirements(spark, sf_dir):
    """A10: every gap of every framework"""
    return aggregate.compliance_gaps(facts(spark, sf_dir)).select("framework", F.explode("critical_gaps").alias("gap"))
