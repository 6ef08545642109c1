"""Confidence, compliance, scores, aggregates and comparison on hand-made findings."""

import pytest
from pyspark.sql import functions as F

from cipherledger import schema
from cipherledger.fixed import compliance_rules, dimensions, scoring_tables
from cipherledger.functions import scoring
from cipherledger.operators import aggregate, compare, enrich, migration, post, report
from cipherledger.sources import findings as finding_sources


def row(rule="R", severity="high", risk="vulnerable", family="RSA", name=None, key_size=None, path="src/a.py", line=1, text="x", before=(), after=(),
        confidence=1.0, recommendation="do", scanner="source", replacements=(), a=None):
    algorithm = (name or f"{family}-x", family, key_size, risk, list(replacements), None, "d")
    return (rule, severity, risk, algorithm, (path, line, text, list(before), list(after)), "m", recommendation, [], confidence, scanner,
            (0, path, line if a is None else a, 0, 0))


@pytest.fixture
def findings(spark):
    return lambda *rows: spark.createDataFrame(list(rows), schema.FINDING)


def test_confidence_steps(findings):
    cases = [
        (row("plain"), 1.0),
        (row("test", path="tests/a.py"), 0.7),
        (row("spec", path="src/inspector.py"), 0.7),
        (row("dir", path="mytests/a.py"), 1.0),
        (row("nosec", text="x  # nosec"), 0.5),
        (row("comment", text="  # x"), None),
        (row("lifted", text="// x", after=["password"]), 0.30000000000000004),
        (row("secret", confidence=0.7, before=["API_KEY"]), 0.8999999999999999),
        (row("demo", before=["an example"]), 0.8),
        (row("gone", path="test/a.py", text="x # noqa"), None),  # 1.0 - 0.3 - 0.5 is just below 0.2
        (row("capped", after=["secret", "demo"]), 0.8),
    ]
    got = {r["rule_id"]: r["confidence"] for r in enrich.adjust_confidence(findings(*[r for r, _ in cases])).collect()}
    assert got == {r[0]: value for r, value in cases if value is not None}


def test_compliance_conditions(findings):
    assert len(compliance_rules.REQUIREMENTS) == 45 and len({r[0] for r in compliance_rules.REQUIREMENTS}) == 14
    refs = enrich.explode_compliance(findings(
        row("rsa", key_size=1024), row("rsa_any"), row("des", family="DES"), row("pqc", family="ML-KEM", risk="safe"), row("aes", family="AES", risk="weakened"),
    )).collect()
    frameworks = {}
    for ref in refs:
        frameworks.setdefault(ref["rule_id"], set()).add(ref["framework"])
    # the ENS and ANSSI key-size rules apply to the sized key only
    assert len(frameworks["rsa"]) == 14 and frameworks["rsa"] - frameworks["rsa_any"] == {"ENS"}
    assert len(frameworks["des"]) == 14 and "pqc" not in frameworks
    assert frameworks["aes"] == {"EU PQC Roadmap", "ISO 27001", "PCI DSS v4.0"}
    sized = {(r["rule_id"], r["requirement_id"]) for r in refs if r["framework"] == "NIST"}
    assert ("rsa", "SP 800-131A") in sized and ("rsa_any", "SP 800-131A") not in sized


def test_compliance_strings(findings):
    got = enrich.attach_compliance(findings(row("r", risk="vulnerable", family="MD5")), ["NIS2"]).first()["compliance_refs"]
    assert got == [
        "NIS2 Art 21.2.e: Cryptographic controls — algorithm is quantum-vulnerable; migration planning required (deadline: 2024-10-17)",
        "NIS2 Art 21.2.e: Cryptographic controls — MD5 is classically broken and non-compliant (deadline: 2024-10-17)",
    ]


def test_duplicates_keep_the_first(findings):
    kept = post.deduplicate(findings(row("R", line=3, text="second", a=2), row("R", line=3, text="first", a=1), row("R", line=4), row("S", line=3)))
    assert sorted((r["rule_id"], r["location"]["line_number"], r["location"]["line_content"]) for r in kept.collect()) == [
        ("R", 3, "first"), ("R", 4, "x"), ("S", 3, "x")
    ]


def test_group_limits_act_before_the_shuffle(findings):
    plan = post.deduplicate(findings(row()))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_summary_and_gate(findings):
    summary = aggregate.summarise(findings(row(severity="critical"), row(severity="low", risk="safe"), row(severity="high", path="b"), row(severity="info")))
    got = summary.first()
    assert (got["score"], got["grade"], got["files_scanned"], got["pqc_readiness_pct"]) == (81.5, "B", 2, 25.0)
    assert got["by_severity"] == {"critical": 1, "low": 1, "high": 1, "info": 1}
    gate = aggregate.quality_gate(summary).first()
    assert not gate["passed"] and gate["reasons"] == ["Critical findings: 1 (max allowed: 0)"]
    empty = aggregate.summarise(findings().where("false"))
    assert empty.first()["score"] == 100.0 and aggregate.quality_gate(empty).first()["passed"]


def test_grades_use_the_unrounded_score(spark):
    scores = [90.0, 89.96, 75.0, 60.0, 40.0, 39.99]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select(scoring.grade(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["A", "B", "B", "C", "D", "F"]


def test_inventory(findings):
    many = [row(name="RSA", path=f"f{i:03d}", severity="low", risk="weakened", scanner="secrets", key_size=1, a=i) for i in range(60)]
    got = aggregate.crypto_inventory(findings(*many, row(name="RSA", path="f000", severity="critical", risk="unknown", a=99)), locations=50).first()
    assert (got["occurrence_count"], got["severity"], got["quantum_risk"], got["asset_type"]) == (61, "critical", "weakened", "key")
    assert got["locations"] == [f"f{i:03d}" for i in range(50)]
    assert aggregate.inventory_locations(findings(*many)).count() == 60
    component = finding_sources.cyclonedx_components(aggregate.crypto_inventory(findings(*many), locations=50), shown=20).first()
    assert component["cryptoProperties"]["assetType"] == "related-crypto-material" and len(component["occurrences"]) == 20


def test_gaps_debt_and_distribution(findings):
    gaps = aggregate.compliance_gaps(findings(row(), row(family="DES")))
    nist = gaps.where("framework = 'NIST'").first()
    assert (nist["total_findings_checked"], nist["non_compliant_count"], nist["action_required_count"], nist["compliance_percentage"]) == (2, 1, 1, 0.0)
    totals = aggregate.gap_totals(gaps).first()
    assert totals["most_critical_framework"] == "ANSSI" and totals["overall_compliance_pct"] == 0.0
    none = aggregate.gap_totals(aggregate.compliance_gaps(findings().where("false"))).first()
    assert (none["total_gaps"], none["overall_compliance_pct"], none["most_critical_framework"]) == (0, 0.0, "")
    debt = aggregate.crypto_debt(findings(row(), row(family="DES", severity="critical"), row(family="AES", risk="weakened", severity="medium"))).first()
    assert debt["total_debt_score"] == 15.0 + 16.0 + 3.0 and debt["estimated_remediation_hours"] == 68.0
    assert debt["debt_interest_rate"] == round(15.0 / 34.0 * 15.0, 1)
    assert aggregate.crypto_debt(findings().where("false")).first()["total_debt_score"] == 0.0
    spread = {r["level"]: (r["n"], r["pct"]) for r in aggregate.severity_distribution(findings(row(), row(severity="low"))).collect()}
    assert spread == {"critical": (0, 0.0), "high": (1, 50.0), "medium": (0, 0.0), "low": (1, 50.0), "info": (0, 0.0)}


def test_a_summary_of_several_scans_is_an_error(findings):
    one = aggregate.summarise(findings(row()))
    tasks = migration.migration_tasks(findings(row()))
    assert migration.migration_plan(tasks, one).first()["total_findings"] == 1
    with pytest.raises(Exception, match="several scans"):
        migration.migration_plan(tasks, one.union(one)).collect()


def test_timelines_follow_the_first_finding(findings):
    got = aggregate.timelines(findings(row(risk="safe", a=1), row(risk="vulnerable", a=2), row(key_size=1024), row(family="MD5"))).collect()
    assert [(r["timeline_key"], r["break_year_moderate"]) for r in got] == [("RSA-1024", 2032)]


def test_migration(findings):
    tasks = {r["from_algorithm"]: r for r in migration.migration_tasks(findings(
        *[row(path=f"p{i}") for i in range(6)], row(family="AES", risk="weakened", severity="low"), row(family="ML-KEM", risk="safe"),
    )).collect()}
    assert set(tasks) == {"AES", "RSA"}
    rsa, aes = tasks["RSA"], tasks["AES"]
    assert (rsa["task_id"], rsa["priority"], rsa["phase"], rsa["estimated_hours"], rsa["estimated_cost_eur"], rsa["complexity"]) == ("MIG-002", 1, 1, 12.0, 1800.0, "high")
    assert (aes["priority"], aes["phase"], aes["recommended_approach"], aes["to_algorithm"]) == (4, 4, "direct_replacement", "PQC equivalent")
    empty = migration.migration_plan(migration.migration_tasks(findings().where("false"))).first()
    assert (empty["total_tasks"], empty["overall_timeline_months"]) == (0, 1)


def test_effort_and_vendor_thresholds(spark):
    hours = spark.createDataFrame([(2.0,), (8.0,), (24.0,), (24.1,)], "h double").select(scoring.complexity(F.col("h"))).collect()
    assert [r[0] for r in hours] == ["low", "medium", "high", "critical"]
    files = spark.createDataFrame([(5,), (20,), (50,), (51,)], "n int").select(scoring.file_multiplier(F.col("n"))).collect()
    assert [r[0] for r in files] == [1.0, 1.5, 2.0, 3.0]
    cases = [("hsm", False, False), ("tls_config", False, False), ("key_management", True, False), ("key_management", False, False), ("library_call", True, True)]
    rows = spark.createDataFrame(cases, "u string, c boolean, f boolean").select(scoring.vendor(F.col("u"), F.col("c"), F.col("f"))).collect()
    assert [r[0] for r in rows] == ["PQShield", "QuSecure", "QuSecure", "OpenSource", "PQShield"]


def test_qvss_bounds_and_environment(spark):
    rows = spark.createDataFrame([(f, r, k) for f in ["RSA", "MD5", "SHA-3", "Random"] for r in dimensions.RISKS for k in (None, 1024, 4096)], "f string, r string, k int")
    args = (F.col("f"), F.col("r"), F.col("k"))
    got = rows.select(scoring.qvss(*args, 0, 0, 0).alias("low"), scoring.qvss(*args).alias("mid"), scoring.qvss(*args, 10, 10, 10).alias("high")).collect()
    for r in got:
        assert 0 <= r["low"]["overall_score"] <= r["mid"]["overall_score"] <= r["high"]["overall_score"] <= 10
    one = spark.range(1).select(scoring.qvss(F.lit("RSA"), F.lit("vulnerable"), F.lit(1024)).alias("q")).first()["q"]
    assert (one["key_strength"], one["base_score"], one["severity_label"]) == (9.5, 9.2, "High")


def test_harvest_risk(spark):
    def of(year, now, shelf, sensitivity="internal"):
        return spark.range(1).select(scoring.harvest_risk(F.lit(year), now, shelf, sensitivity).alias("h")).first()["h"]

    assert of(2030, 2026, 10)["urgency"] == "immediate"
    assert of(2036, 2026, 10)["urgency"] == "urgent"
    assert of(2043, 2026, 10)["urgency"] == "planned"
    assert of(2080, 2026, 10)["urgency"] == "monitor" and of(2080, 2026, 10)["hndl_score"] == 0.0
    assert of(2030, 2026, 30, "top_secret")["hndl_score"] == 100.0
    for early, middle, late in [(y[2], y[3], y[4]) for y in scoring_tables.BREAK_YEARS]:
        assert early <= middle <= late


def test_compare(findings):
    before = findings(row("gone"), row("same"), row("moved", severity="low"), row("same", line=9))
    after = findings(row("same"), row("moved", severity="high"), row("fresh"))
    status = {r["rule_id"]: r["status"] for r in compare.finding_status(before, after).collect()}
    assert status == {"gone": "resolved", "same": "unchanged", "moved": "changed", "fresh": "new"}
    assert [r["rule_id"] for r in compare.new_findings(before, after).collect()] == ["fresh"]
    assert [r["rule_id"] for r in compare.resolved_findings(before, after).collect()] == ["gone"]
    assert compare.unchanged_keys(before, after).count() == 2
    got = compare.compare_scans(before, after, aggregate.summarise(before), aggregate.summarise(after)).first()
    assert got["score_change"] == 1.5  # 77.5 to 79.0
    assert got["summary"] == "Score improved by 1.5 points. (B -> B). 1 new findings. 1 resolved findings. 2 unchanged"


def test_trend(spark):
    days = [("t", f"2026-01-{d:02d}", s) for d, s in ((1, 50.0), (2, 60.0), (3, 70.0))] + [("u", "2026-01-01", 80.0)]
    scans = spark.createDataFrame(days, "target string, day string, score double").withColumn("ts", F.to_timestamp("day"))
    got = {r["target"]: r for r in compare.score_trend(scans).collect()}
    assert (got["t"]["score_trend"], got["t"]["average_improvement_per_scan"], got["t"]["projected_compliance_date"]) == ("improving", 10.0, "2026-01-05")
    assert got["u"]["score_trend"] == "stable" and got["u"]["projected_compliance_date"] is None


def test_reports(findings):
    rows = findings(row("b", severity="low", recommendation="", name="A"), row("a", severity="critical", name="A", replacements=["X", "Y"], path="p/q.py", line=7))
    shown = {r["severity"]: r for r in report.finding_rows(rows).collect()}
    assert shown["critical"]["place"] == "p/q.py:7" and shown["critical"]["file_name"] == "q.py" and shown["low"]["recommendation"] == "—"
    assert [tuple(r)[:3] for r in report.unique_recommendations(rows).select("algorithm", "recommendation", "replacements").collect()] == [("A", "do", "X, Y")]
    top = report.top_findings(rows, 1).collect()
    assert len(top) == 1 and top[0]["rule_id"] == "a" and top[0]["left_out"] == 1
    results = {r["ruleId"]: r for r in finding_sources.sarif_results(rows).collect()}
    assert results["a"]["level"] == "error" and results["b"]["level"] == "note" and {r["ruleIndex"] for r in results.values()} == {0, 1}
    assert "ord" not in finding_sources.as_json(rows).first()["json"]


def test_a_rule_with_most_findings_is_split_and_rules_are_numbered_in_ranges(findings):
    rows = [row("hot", path=f"p{i % 50}.py", line=i, a=i) for i in range(2000)] + [row(f"r{i}", path=f"q{i}.py", line=1) for i in range(100)]
    rows = findings(*rows)
    results = finding_sources.sarif_results(rows)
    assert results.count() == 2100
    index = {r["id"]: r["rule_index"] for r in finding_sources.sarif_rules(rows).collect()}
    firsts = sorted(index, key=lambda r: ("p0.py", 0) if r == "hot" else (f"q{r[1:]}.py", 1))
    assert index == {rule: i for i, rule in enumerate(firsts)}
    assert all(r["ruleIndex"] == index[r["ruleId"]] for r in results.collect())
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "part" in plan
    logical = results._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(ord" not in logical  # no window without a partition
