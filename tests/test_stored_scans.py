"""Stored scans: comparison without a shuffle, summaries that follow changes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cipherledger import schema
from cipherledger.operators import aggregate, compare
from cipherledger.sources.scans import _table_name, read_scan, write_scan
from tests.test_findings import row


@pytest.fixture
def two(spark, tmp_path):
    before = [row(f"r{i % 7}", path=f"p{i % 40}.py", line=i, severity=["high", "low"][i % 2], a=i) for i in range(400)]
    before[0] = row("gone", path="g.py", line=1)
    before += [row("hot", path="one.py", line=i, a=i) for i in range(300)]
    after = before[50:] + [row("new", path=f"n{i}.py", line=1, severity="critical", risk="safe") for i in range(30)] + [row("r0", path="p0.py", line=900, severity="info", a=900)]
    frames = [spark.createDataFrame(rows, schema.FINDING) for rows in (before, after)]
    stored = [write_scan(f, str(tmp_path / name), ["/src"], datetime(2026, 1, day), name, buckets=8) for day, (f, name) in enumerate(zip(frames, "ab"), 1)]
    return frames, stored


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_stored_scans_compare_without_a_shuffle(spark, two):
    frames, (a, b) = two
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        status = compare.key_status(a.keys, b.keys)
        plan = status._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert rows_of(status) == rows_of(compare.finding_status(*frames))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["status"] for r in status.collect()} == {"new", "resolved", "changed", "unchanged"}


def test_a_stored_scan_is_read_in_another_session(spark, two, tmp_path):
    frames, (a, _) = two
    spark.sql(f"DROP TABLE {_table_name(str(tmp_path / 'a'))}")  # a session that has not written it
    again = read_scan(spark, str(tmp_path / "a"))
    assert again.keys.count() == compare.keyed(frames[0]).count()
    assert rows_of(again.findings) == rows_of(frames[0].select(again.findings.columns))
    summary = again.summary.first()
    assert (summary["scan_id"], summary["targets"], summary["ts"]) == ("a", ["/src"], datetime(2026, 1, 1))
    whole = aggregate.summarise(frames[0]).first()
    assert {k: summary[k] for k in whole.asDict()} == whole.asDict()


def test_a_summary_follows_changes(spark, two):
    (before, after), (a, _) = two
    came, went = after.exceptAll(before), before.exceptAll(after)
    state = aggregate.updated_state(a.state, came, went)
    assert rows_of(state) == rows_of(aggregate.summary_state(after))
    assert aggregate.summary_of_state(state).collect() == aggregate.summarise(after).select(aggregate.summary_of_state(state).columns).collect()
    assert aggregate.advanced_of_state(state, 90).collect() == aggregate.advanced_score(after, 90).collect()
    nothing = aggregate.updated_state(a.state, before.limit(0), before)
    assert nothing.count() == 0 and aggregate.summary_of_state(nothing).first()["score"] == 100.0


def test_states_of_parts_add_up(two):
    (before, _), _ = two
    parts = [before.where(F.col("ord.a") % 3 == k) for k in range(3)]
    assert rows_of(aggregate.merged_state([aggregate.summary_state(p) for p in parts])) == rows_of(aggregate.summary_state(before))
