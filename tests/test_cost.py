"""Work done once, where a plan could repeat it for every match, library or row."""

import pytest
from pyspark.sql import functions as F

from cipherledger.fixed import compliance_rules, config_rules
from cipherledger.functions import text
from cipherledger.operators import detect_config, detect_endpoints, detect_manifests, enrich, lines, post
from cipherledger.operators.detect_text import secrets_detector
from cipherledger.operators.hits import assemble, find_first
from cipherledger.sources import rules as rule_tables
from verification import corpus, finding_queries


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_one_row_group_is_no_single_task(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x\ny").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    files = corpus.CODE.files(spark, str(tmp_path))
    assert "RepartitionByExpression" in plan_of(files)
    assert files.count() == 50


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """All that a whole scan reads, with a null text and repeated rows."""
    folder = str(tmp_path_factory.mktemp("tables"))
    made = {
        "documents": ([(i, f"first {i}\nRSA_generate_key_ex\n" * 9) for i in range(60)] + [(3, None), (4, "twice"), (4, "twice")], "doc_id long, text string"),
        "customer": ([(i, f"name {i}", i % 5) for i in range(40)] + [(7, "name 7", 2)] * 2, "c_custkey long, c_name string, c_nationkey int"),
        "supplier": ([(i,) for i in range(10)] + [(3,)], "s_suppkey long"),
        "orders": ([(i * 500, i % 7) for i in range(80)] + [(1500, 3)], "o_orderkey long, o_custkey long"),
    }
    for name, (rows, columns) in made.items():
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["standard_profile", "deep_profile", "paranoid_profile", "every_detector"])
def test_a_whole_scan_deals_documents_once(spark, tables, name):
    frame = getattr(finding_queries, name)(spark, tables)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_COL") == plan.count("ReusedExchange") + 1 == 1 + (name in ("paranoid_profile", "every_detector"))


def test_files_of_all_corpora_are_those_of_each(spark, tables):
    apart = post.union_all([c.files(spark, tables) for c in finding_queries.TEXTS])
    together = corpus.files_of(finding_queries.TEXTS, spark, tables)
    assert together.columns == apart.columns and sorted(map(repr, together.collect())) == sorted(map(repr, apart.collect()))


def test_a_path_is_shuffled_once_to_drop_duplicates(spark, tables):
    found = detect_endpoints.detect_calls(corpus.calls(spark, tables)).union(detect_endpoints.detect_certificates(corpus.certificates(spark, tables)))
    kept = post.deduplicate_placed(found)
    assert kept.schema == found.schema and kept.count() < found.count()
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, post.deduplicate(found).collect()))
    plan = kept.select("rule_id", "location.file_path", "location.line_number")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "_location_file_path" in line and "Project [" in line][-1]
    assert dealt.count("path") == 2  # what it is made of and its name


def test_manifests_are_read_once_however_many_libraries(make_files):
    pom = "<dependency>\n<groupId>org.bouncycastle</groupId>\n<artifactId>bcprov</artifactId>\n</dependency>"
    gradle = "// none\nimplementation 'ORG.JASYPT:jasypt:1.9'\napi group: 'com.nimbusds:nimbus-jose-jwt', name: 'x'\ncompile 'a:b:1'"
    found = detect_manifests.detect_java_manifests(make_files({"pom.xml": pom, "build.gradle": gradle}))
    assert sorted((r[0], r[1], r[2]) for r in found.select("location.file_path", "location.line_number", "rule_id").collect()) == [
        ("build.gradle", 2, "DEP-JAVA-JASYPT"), ("build.gradle", 3, "DEP-JAVA-NIMBUS"), ("pom.xml", 1, "DEP-JAVA-BOUNCYCASTLE"),
    ]
    assert plan_of(found).count("<groupId>") <= 2  # its test and its pattern


def test_entropy_measures_the_text_once(spark):
    rows = spark.createDataFrame([("",), ("aab\U0001f600",), (None,), ("aa",)], "t string").select(text.string_entropy(F.col("t")).alias("h"))
    assert [None if r[0] is None else round(r[0], 6) for r in rows.collect()] == [0.0, 1.5, None, 0.0]
    assert plan_of(rows).count("length(t") == 2


def test_lines_without_a_required_string_meet_no_pattern(spark):
    rules = [r for r in rule_tables.resolve_rules(rule_tables.load_source_rules()) if r[2] == "python"]
    rows = spark.createDataFrame([("digest = hashlib.md5(data)", "python"), ("nothing", "python"), (None, "python")], "line string, language string")
    found = lines.match_lines(rows, rules)
    assert [r[0] for r in found.select("line").collect()] == ["digest = hashlib.md5(data)"]
    assert "Contains(line" in plan_of(found)


@pytest.mark.parametrize("frameworks", [None, ["NIST", "GDPR"], []])
def test_requirements_are_those_of_the_tests_row_by_row(spark, frameworks):
    families = sorted({f for r in compliance_rules.REQUIREMENTS for f in r[2]}) + [None, "Other", ""]
    risks = ["vulnerable", "weakened", "safe", "unknown", None, ""]
    rows = [(((f"n {f}", f, size)), k) for f in families for k in risks for size in (None, 0, 1023, 1024, 2047, 2048, 3071, 3072, 9999)]
    findings = spark.createDataFrame(rows, "algorithm struct<name:string,family:string,key_size:int>, quantum_risk string").withColumn(
        "algorithm", F.when(F.col("algorithm.key_size") == 0, F.lit(None)).otherwise(F.col("algorithm"))
    )
    got = enrich.explode_compliance(findings, frameworks)
    if frameworks == []:
        assert got.count() == 0
        return
    want = findings.withColumn("ref", F.explode(enrich.compliance_refs(frameworks=frameworks))).select("*", "ref.*").drop("ref")
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert plan_of(got).count("CASE WHEN") < 20


def test_directives_are_numbered_once_however_many_values(make_files):
    files = make_files({"nginx.conf": "listen 1;\nssl_protocols TLSv1;\n\n  ssl_protocols SSLv3 TLSv1.1;\n", "site.conf": "SSL\n"})
    found = detect_config.detect_tls(files)
    assert sorted(r[0] for r in found.where("location.file_path = 'nginx.conf'").select("location.line_number").collect()) == [2, 4, 4]
    assert found.where("location.file_path = 'site.conf'").count() == 0
    assert "rlike" in plan_of(found).lower()
    assert plan_of(found).lower().count("regexp_replace(tls_text") <= len(config_rules.TLS_DIRECTIVES)


def test_neighbours_are_lowered_once(make_files):
    rows = find_first(make_files({"a.ini": "x"}), assemble([secrets_detector()]))
    assert plan_of(rows).lower().count("lower(array_join") == 1
