"""The trie of conversations: brute force over made conversations, shards of every size, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cipherledger.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, size int"


def plain_trie(rows):
    """The rows of op12 from ``(conv_id, turn, role, text)``, node by node."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        head = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:head] + turns[head:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[p] for p in children[path]) or 1
        own_saved = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        saved[path] = own_saved + sum(saved[p] for p in children[path])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(spark, monkeypatch, rows, table="conversations"):
    turns = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA)
    monkeypatch.setattr(queries, "table", lambda *_: turns)
    out = queries.op12_prefix_trie(spark, "").collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in out)


def made(seed, n):
    dice = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(dice.choice([0, 1, 2, 3, 7, 9])):
            rows.append((c * dice.choice([1, 1, 3]), turn, dice.choice(["user", "assistant", None]), dice.choice(["a", "bé", "", None, "ccc"])))
    seen = set()
    return [r for r in rows if (r[0], r[1]) not in seen and not seen.add((r[0], r[1]))]


@pytest.mark.parametrize("seed", range(3))
def test_trie_by_brute_force(spark, monkeypatch, seed):
    rows = made(seed, 260)
    assert found(spark, monkeypatch, rows) == plain_trie(rows)


def test_groups_of_copies_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 7)
    rows = [(1000 + i, t, "user", f"turn {t}") for i in range(300) for t in range(8)]
    rows += [(7, t, "user", f"turn {t}") for t in range(3000)]
    rows += [(5000 + i, t, "user", f"turn {t if t < 7 else (t, i)}") for i in range(150) for t in range(9)]
    assert found(spark, monkeypatch, rows) == plain_trie(rows)


def test_odd_turns(spark, monkeypatch):
    rows = [(None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (2, 5, "", ""), (3, 1, "user", "x" * 100_000)]
    assert found(spark, monkeypatch, rows) == plain_trie(rows)
    assert found(spark, monkeypatch, []) == []
    assert found(spark, monkeypatch, [(None, 1, "user", "a")]) == []


def test_shards_finish_all_but_the_skeleton():
    dice = random.Random(5)
    paths = set()
    for _ in range(400):
        name, path = b"", b""
        for _ in range(dice.choice([0, 1, 3, 6])):
            name = hashlib.md5(name + bytes([dice.choice([1, 1, 1, 2, 3])])).digest()
            path += name
        paths.add(path)
    ordered = sorted(paths)
    assert all(trie.shared_turns(a, b) == max(k for k in range(7) if a[: 16 * k] == b[: 16 * k] and len(a) >= 16 * k <= len(b)) for a in ordered[:30] for b in ordered[:30])
    for count in (0, 1, 5, 60):
        bounds = trie.splitters(ordered, count)
        skeleton = frozenset(b[i : i + 16] for b in bounds for i in range(0, len(b), 16))
        shards = defaultdict(list)
        for i, p in enumerate(ordered):
            shards[sum(b <= p for b in bounds)].append((p, b"\1" + b"\0" * 7 if len(p) == 16 else (b"\1" + b"\0" * 7) * (len(p) // 16), i, 1, "x"))
        rows = [r for own in shards.values() for r in trie.of_shard(iter(own), skeleton)]
        whole = [r[0] for r in rows if not r[2]]
        assert len(whole) == len(set(whole))
        assert set(whole) | skeleton | {b""} == {p[i : i + 16] for p in paths for i in range(0, len(p), 16)} | {b""}


def test_texts_do_not_travel(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert trie.own_paths(turns).schema["path"].dataType.elementType.names == ["key", "size"]
    assert trie.chained(trie.own_paths(turns)).where(F.length("path") != F.length("sizes") * 2).count() == 0
