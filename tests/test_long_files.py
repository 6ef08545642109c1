"""Files in pieces, running values by splits: the same as whole files and as a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from cipherledger.operators.detect_manifests import running_marker
from cipherledger.operators.running import LAST, SUM, numbered, running
from cipherledger.plans.long_scan import around, scan_long_files, searched
from cipherledger.plans.scan import scan
from cipherledger.sources.files import read_files
from cipherledger.sources.long_files import read_pieces

COLUMNS = ["rule_id", "severity", "algorithm", "location", "message", "confidence", "compliance_refs", "scanner_type", "ord"]
LINES = [
    "h = hashlib.md5(x)", "key = rsa.generate_private_key(key_size=1024)", "# note", "", "x = 1", "password = 'hunter22'", "demo = 2",
    "a\x0bb", "café   next", "r\rs", "end\r", "from Crypto.Cipher import DES3; h = hashlib.md5(y)", "  ", "tail\x85",
]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def plant(root):
    dice = random.Random(3)
    for name, n in (("a.py", 400), ("b.py", 3), ("c.ini", 90), ("sshd_config", 60), ("d.py", 1)):
        lines = [dice.choice(["Ciphers 3des-cbc", "# no", "MACs hmac-md5"] if name == "sshd_config" else LINES) for _ in range(n)]
        (root / name).write_bytes("\n".join(lines).encode() + (b"\n" if n % 2 else b""))
    (root / "e.py").write_bytes(b"import hashlib\nh = hashlib.md5(x)\x0b")
    (root / "f.py").write_bytes(b"bad \xff bytes = hashlib.md5(x)\n" * 40 + b"h = hashlib.md5(x)\r\n\r\n")
    (root / "g.py").write_bytes(b"x" * 5000 + b" hashlib.md5(\n" + b"y\n" * 5)
    (root / "empty.py").write_bytes(b"")
    return str(root)


@pytest.mark.parametrize("piece_bytes", [1, 300, 10_000])
def test_pieces_give_the_findings_of_whole_files(spark, tmp_path, small_ranges, piece_bytes):
    root = plant(tmp_path)
    whole = scan(read_files(spark, root), detectors=["source", "config", "secrets"]).select(COLUMNS)
    parts = scan_long_files(read_pieces(spark, [root], piece_bytes=piece_bytes)).select(COLUMNS)
    assert whole.count() > 100
    assert parts.exceptAll(whole).collect() == [] and whole.exceptAll(parts).collect() == []


def test_a_file_is_dealt_over_many_tasks_in_small_pieces(spark, tmp_path, small_ranges):
    (tmp_path / "long.py").write_text("h = hashlib.md5(x)\n" * 2000)
    pieces = read_pieces(spark, [str(tmp_path)], piece_bytes=200)
    rows = pieces.select("place", "bytes", F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in rows}) > 20 and max(r["bytes"] for r in rows) <= 200 + 19
    assert sum(r["bytes"] for r in rows) == 19 * 2000 and len({r["place"] for r in rows}) == len(rows)
    found, rules = searched(pieces, ["source"])
    assert "content" not in found.columns and "lines" not in found.columns
    numbers = [r[0] for r in around(found, split_places=2**20).select("lines_before").orderBy("lines_before").collect()]
    assert numbers[0] == 0 and len(set(numbers)) == len(rows)
    places = scan_long_files(pieces).select("location.line_number").distinct().count()
    assert places == 2000


def test_the_files_are_read_once(spark, tmp_path):
    (tmp_path / "long.py").write_text("h = hashlib.md5(x)\n" * 50)
    plan = scan_long_files(read_pieces(spark, [str(tmp_path)]))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "MapInArrow" not in plan


@pytest.mark.parametrize("split_rows, levels", [(1, 3), (7, 2), (7, 1), (10_000, 2), (3, 0)])
def test_running_values_equal_a_fold(spark, split_rows, levels):
    dice = random.Random(split_rows)
    rows = [(k, i, dice.choice([None, None, None, f"m{i}"]), dice.choice([None, 1, 2])) for k in ("a", "b", None) for i in range(1, 120)]
    table = spark.createDataFrame(rows, "k string, i long, m string, n long").repartition(5)
    values = {"last": (F.col("m"), LAST), "total": (F.col("n"), SUM)}
    for before in (False, True):
        got = {(r["k"], r["i"]): (r["last"], r["total"]) for r in running(table, ["k"], "i", values, before=before, split_rows=split_rows, levels=levels).collect()}
        state = {}
        for k, i, m, n in rows:
            last, total = state.get(k, (None, 0))
            state[k] = after = (last if m is None else m, total + (n or 0))
            assert got[(k, i)] == ((last, total) if before else after)


def test_no_window_sees_a_whole_file(spark):
    lines = spark.range(1, 5001).select(F.lit("one").alias("path"), F.col("id").alias("line_number"))
    marker = F.when(F.col("line_number") % 1300 == 0, F.col("line_number").cast("string"))
    marked = running_marker(lines, marker, "section", split_rows=100)
    wrong = marked.where(~F.col("section").eqNullSafe(F.nullif((F.floor(F.col("line_number") / 1300) * 1300).cast("string"), F.lit("0"))))
    assert marked.count() == 5000 and wrong.count() == 0
    windows = [w for w in marked._jdf.queryExecution().optimizedPlan().toString().split("Window [")[1:] if "line_number" in w.split("\n")[0]]
    assert windows and all("_split_2" in w.split("\n")[0] for w in windows)


def test_numbers_over_all_tasks(spark):
    dice = random.Random(9)
    rows = [(dice.randint(0, 50), dice.randint(0, 10**6)) for _ in range(3000)]
    table = spark.createDataFrame(rows, "a int, b int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(table, ["a", "b"], "n")
        assert sorted((r["n"], r["a"], r["b"]) for r in got.collect()) == [(i, *row) for i, row in enumerate(sorted(rows))]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert numbered(table.limit(0), ["a", "b"], "n").count() == 0
