"""Whole scans, files on disk, presets, user rules, streams."""

import os

import pytest

from pyspark.sql import functions as F

import cipherledger
from cipherledger import schema
from cipherledger.operators import aggregate, detect_binary, detect_config, detect_manifests, detect_text, post
from cipherledger.operators.routing import is_scannable, scannable_glob
from cipherledger.plans.scan import detect, finish, scan
from cipherledger.sources.files import read_files, read_targets
from cipherledger.sources.findings import read_findings, write_findings
from cipherledger.sources.rules import SourceRule, load_source_rules, refused_rules
from cipherledger.streaming.incremental import findings_of, scan_stream, watch_files
from tests.conftest import places

TREE = {
    "app/main.py": b"import hashlib\nh = hashlib.md5(x)\nbad \xff bytes = rsa.generate_private_key(key_size=1024)\n",
    "app/safe.py": b"# RSA and MD5 are only named here\nh = hashlib.sha256(x)\n",
    "tests/t.py": b"h = hashlib.sha1(x)\n",
    "etc/sshd_config": b"Ciphers 3des-cbc\n",
    "etc/nginx.conf": b"ssl_protocols SSLv3;\n",
    "requirements.txt": b"rsa\n",
    "infra/main.tf": b"rsa_bits = 2048\n",
    "k8s/c.yaml": b"apiVersion: v1\nkind: Certificate\n size: 1024\n",
    "bin/lib.so": b"\x00\x01" * 64 + b"EVP_md5",
    "build/gen.py": b"h = hashlib.md5(x)\n",
    ".env": b"password = 'hunter22'\n",
    "conf/app.env.ini": b"password = 'hunter22'\n",
}


def plant(root):
    for path, raw in TREE.items():
        target = os.path.join(root, path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as handle:
            handle.write(raw)
    return str(root)


def short(findings):
    return sorted({(os.path.basename(path), rule) for path, _, rule in places(findings)})


def test_scan_a_directory(spark, tmp_path):
    files = read_files(spark, plant(tmp_path), excludes=["build/", "*.md"])
    found = scan(files)
    assert short(found) == sorted([
        ("main.py", "PY-MD5-USE"), ("main.py", "PY-RSA-GENERATE"), ("main.py", "PY-RSA-KEYSIZE-1024"), ("t.py", "PY-SHA1-USE"),
        ("sshd_config", "ssh-weak-ciphers-3des-cbc"), ("nginx.conf", "tls-weak-protocol-sslv3"), ("requirements.txt", "DEP-PY-RSA"),
        ("main.tf", "IAC-TF-RSA-2048"), ("c.yaml", "CTR-K8S-CERTMGR"), ("c.yaml", "CTR-K8S-CERTMGR-1024"), ("lib.so", "BIN-STR-EVP-MD5"),
        ("app.env.ini", "SEC-WEAK-HARDCODEDSECRET"),
    ])  # .env has no suffix and is not read
    line = found.where("rule_id = 'PY-RSA-GENERATE'").first()
    assert line["location"]["line_content"].startswith("bad  bytes") and len(line["compliance_refs"]) > 10
    confidence = {r["rule_id"]: r["confidence"] for r in found.collect()}
    assert confidence["PY-SHA1-USE"] == 0.7


def test_only_scannable_files_are_opened(spark, tmp_path):
    root = plant(tmp_path)
    for name in ("logo.png", "notes.md", "x/PIPFILE", "Dockerfile.dev", "x/Containerfile"):
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "wb") as handle:
            handle.write(b"RUN openssl genrsa 1024\n")
    every = read_files(spark, root)
    chosen = read_files(spark, root, name_glob=scannable_glob())
    kept = every.where(is_scannable(F.col("name"), F.col("suffix")))
    names = sorted(r["name"] for r in chosen.select("name").collect())
    assert names == sorted(r["name"] for r in kept.select("name").collect())
    assert "PIPFILE" in names and "logo.png" not in names and "Dockerfile.dev" in names
    assert places(scan(chosen)) == places(scan(every))


def test_missing_targets_and_single_files(spark, tmp_path):
    root = plant(tmp_path)
    assert read_targets(spark, [f"{root}/nowhere"]).count() == 0
    one = read_targets(spark, [f"{root}/build/gen.py", f"{root}/nowhere"], excludes=["*.py"])
    assert [r["name"] for r in one.collect()] == ["gen.py"]  # a file given as a target is never excluded
    assert scan(read_targets(spark, [f"{root}/nowhere"])).count() == 0


def test_safe_code_has_no_findings(make_files):
    files = make_files({"app/safe.py": "# uses RSA and MD5 nowhere\nimport secrets\nh = hashlib.sha256(x)\n", "empty.py": ""})
    summary = aggregate.summarise(scan(files)).first()
    assert (summary["total_findings"], summary["score"], summary["grade"]) == (0, 100.0, "A")


def test_one_pass_equals_the_single_detectors(spark, tmp_path):
    files = read_files(spark, plant(tmp_path))
    texts = cipherledger.as_text(files.where("suffix != '.so'"))
    single = [
        detect_text.detect_source(texts), detect_text.detect_secrets(texts), detect_config.detect_ssh(texts), detect_config.detect_tls(texts),
        detect_manifests.detect_python_manifests(texts), detect_text.detect_terraform(texts), detect_text.detect_kubernetes(texts),
        detect_binary.detect_strings(files), detect_binary.detect_symbols(files),
    ]
    columns = ["rule_id", "severity", "quantum_risk", "algorithm", "location", "message", "confidence", "scanner_type", "ord"]
    together = detect(files).select(columns)
    apart = post.union_all(single).select(columns)
    assert together.exceptAll(apart).count() == 0 and apart.exceptAll(together).count() == 0


def test_files_are_read_once(spark, tmp_path):
    plan = detect(read_files(spark, plant(tmp_path)), detectors=["source", "config", "dependency", "secrets", "iac", "container"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Exchange hashpartitioning" not in text and "CartesianProduct" not in text


def test_a_text_scan_shuffles_nothing(spark, tmp_path):
    plan = scan(read_files(spark, plant(tmp_path)), detectors=["source", "config", "dependency", "secrets", "iac", "container"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Exchange") == text.count("BroadcastExchange")
    assert "Sort" not in text and "Window" not in text


def test_duplicates_dropped_in_the_row_are_those_dropped_by_a_window(spark, make_files):
    twice = "h = hashlib.md5(x); g = hashlib.md5(y)\nrequire_once = sha1(x)  # nosec\n"
    files = make_files({
        "tests/a.py": twice * 5, "b.py": "# demo\n" + twice, "pom.xml": "<dependency>\n<artifactId>jasypt</artifactId>\n</dependency>\n" * 3,
        "sshd_config": "Ciphers 3des-cbc,3des-cbc,arcfour\n" * 2, "n.conf": "ssl_ciphers RC4-SHA:RC4-SHA:DES-CBC3-SHA;\n",
        "m.tf": "rsa_bits = 2048 rsa_bits = 2048\n" * 2, "empty.py": "", "go.mod": "require golang.org/x/crypto v0\n" * 2,
    })
    one_by_one = finish(detect(files))
    in_rows = scan(files)
    columns = ["rule_id", "severity", "algorithm", "location", "message", "confidence", "compliance_refs", "scanner_type", "ord"]
    assert in_rows.select(columns).exceptAll(one_by_one.select(columns)).count() == 0
    assert one_by_one.select(columns).exceptAll(in_rows.select(columns)).count() == 0 and in_rows.count() < detect(files).count()
    own = [SourceRule("SAME", lang, "MD5", pattern) for lang in ("python",) for pattern in ("md5", "hashlib", "h =")]
    assert places(scan(files, detectors=["source"], rules=own)) == places(finish(detect(files, detectors=["source"], rules=own)))


def test_domains_and_calls_are_inputs_of_a_scan(spark):
    domains = spark.createDataFrame([("a.org",), ("b.org",)], "domain string")
    records = spark.createDataFrame([("b.org",)], "domain string")
    calls = spark.createDataFrame([("m.py", 3, "hashlib.md5", None, "h = hashlib.md5(x)")], schema.CALLS)
    found = scan(domains=domains, tlsa_records=records, calls=calls)
    assert short(found) == [("a.org", "NET-DNS-NO-DANE"), ("m.py", "AST-PY-MD5")]
    assert short(scan(domains=domains)) == [("a.org", "NET-DNS-NO-DANE"), ("b.org", "NET-DNS-NO-DANE")]
    assert scan(domains=domains, calls=calls, profile="quick").count() == 1


def test_targets_are_told_apart_by_whole_segments(spark, tmp_path):
    for path in ("a/x.py", "ab/x.py", "a/sub/build/x.py", "a/build/y.py"):
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_text("x")
    both = read_targets(spark, [f"{tmp_path}/a", f"{tmp_path}/ab"], excludes=["/x.py"])
    assert sorted(r["path"].split(str(tmp_path))[1] for r in both.collect()) == ["/a/build/y.py", "/a/sub/build/x.py"]
    # a target within another adds no file twice, and anchored excludes are read from the innermost
    nested = read_targets(spark, [f"{tmp_path}/a", f"{tmp_path}/a/sub"], excludes=["/build/"])
    assert sorted(r["path"].split(str(tmp_path))[1] for r in nested.collect()) == ["/a/x.py"]


def test_entropy_is_worked_out_once(spark, tmp_path):
    plan = detect_binary.detect_entropy(read_files(spark, plant(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_presets_and_severity(spark, tmp_path):
    files = read_files(spark, plant(tmp_path))
    quick = scan(files, profile="quick")
    assert {r["scanner_type"] for r in quick.collect()} == {"source"}
    assert {r["severity"] for r in scan(files, min_severity="critical").collect()} == {"critical"}
    # the size that a preset names drops no file
    assert scan(files.withColumn("length", F.lit(2**40)), profile="quick").count() == quick.count()


def test_each_input_alone_gives_its_findings(spark, make_files):
    files = make_files({"a.py": "hashlib.md5(x)\n"})
    assert scan(files, detectors=["certificate"]).collect() == []
    with pytest.raises(ValueError):
        scan()
    offers = spark.createDataFrame(
        [("h", 22, ["diffie-hellman-group1-sha1"], [], [], [], [], [])], schema.SSH_OFFERS)
    assert {r["scanner_type"] for r in scan(ssh_offers=offers).collect()} == {"network"}
    hot = "".join(map(chr, range(256)))
    blob = make_files({"a.so": hot + "ab" * 512})
    assert "BIN-ENTROPY-HIGH" in {r["rule_id"] for r in scan(blob, detectors=["binary"]).collect()}


def test_user_rules_with_flags_and_foreign_spellings(make_files):
    files = make_files({"a.py": "h = MD5(x)\nweak weak\nlast"})
    own = [
        SourceRule("FLAG", "python", "MD5", r"(?i)md5\("), SourceRule("SPACED", "python", "MD5", "(?xi) md5 \\( # call"),
        SourceRule("NAMED", "python", "MD5", r"(?P<a_word>weak)\s(?P=a_word)"), SourceRule("END", "python", "MD5", r"last\Z"),
        SourceRule("BROKEN", "python", "MD5", r"md5(?"), SourceRule("FOREIGN", "python", "MD5", r"(weak)?(?(1)a|b)"),
    ]
    with pytest.warns(UserWarning, match="FOREIGN"):
        found = detect(files, detectors=["source"], rules=own)
    assert sorted(r["rule_id"] for r in found.collect()) == ["END", "FLAG", "NAMED", "SPACED"]
    assert [r for r, _ in refused_rules(files.sparkSession, own)] == ["BROKEN", "FOREIGN"]


def test_pushing_the_severity_down_changes_nothing(make_files):
    files = make_files({"a.php": "md5($x); sodium_crypto_box(); rand(1)\n", "b.cs": "using System.Security.Cryptography; MD5.Create()\n"})
    for severity in ("high", "medium", "low"):
        pushed = scan(files, detectors=["source"], min_severity=severity)
        plain = finish(detect(files, detectors=["source"]), severity)
        assert places(pushed) == places(plain)


def test_languages_and_user_rules(make_files):
    files = make_files({"a.py": "hashlib.md5(x)\nmycrypt(1)\n", "b.go": 'import "crypto/md5"\n'})
    own = SourceRule("OWN-1", "python", "ML-KEM-768", r"^mycrypt\(\d\)$", "own text")
    unknown = SourceRule("OWN-2", "python", "NoSuch", r"mycrypt")
    broken = SourceRule("OWN-3", "python", "MD5", r"mycrypt(")
    found = detect(files, detectors=["source"], rules=load_source_rules(extra=[own, unknown, broken]), languages=["python"])
    rows = {r["rule_id"]: r for r in found.collect()}
    assert set(rows) == {"PY-MD5-USE", "OWN-1", "OWN-2"}
    assert (rows["OWN-1"]["severity"], rows["OWN-1"]["quantum_risk"], rows["OWN-1"]["message"]) == ("info", "safe", "own text")
    assert (rows["OWN-2"]["severity"], rows["OWN-2"]["algorithm"]["family"]) == ("medium", "Unknown")
    assert load_source_rules("cobol") == [] and len(load_source_rules()) == 288


def test_custom_detector(make_files):
    files = make_files({"a.py": "x"})
    found = detect(files, detectors=[], custom=[lambda texts: detect_text.detect_source(texts.withColumn("content", F.lit("hashlib.md5()")))])
    assert places(found) == [("a.py", 1, "PY-MD5-USE")]


def test_stored_findings_come_back(spark, make_files, tmp_path):
    found = scan(make_files({"a.py": "hashlib.md5(x)\nkey_size = 1024\n"}))
    for kind in ("json", "parquet"):
        write_findings(found, str(tmp_path / kind), kind)
        back = read_findings(spark, str(tmp_path / kind), kind)
        assert back.schema.simpleString() == found.select(back.columns).schema.simpleString()
        assert back.exceptAll(found.select(back.columns)).count() == 0 and back.count() == 2


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    root = plant(tmp_path / "in")
    kinds = ["source", "config", "dependency", "secrets", "iac", "container", "binary"]
    stream = watch_files(spark, root)
    assert findings_of(stream, [k for k in kinds]).isStreaming
    for _ in range(2):  # the second run has nothing new
        scan_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), kinds).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert short(streamed) == short(scan(read_files(spark, root), detectors=kinds))
    assert streamed.count() == scan(read_files(spark, root), detectors=kinds).count()
