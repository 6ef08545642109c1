"""The trie of all conversations: which beginnings they share, how many share them, and what sharing saves.

Splitter-skeleton. A conversation's path is a chain of hashes, one for each beginning, so equal entries are equal nodes and
sorted paths keep a node's members together. Sampled paths split the order into shards; the prefixes of the splitters, a
small trie that every task holds, are the only nodes whose members can lie in several shards. Each sorted shard finishes
all other nodes on its own, in one pass with a stack; of skeleton nodes it gives partial aggregates, which are reduced
over the shards and rolled up along the skeleton.

Conversations of one and the same path are one entry from the start, however many they are. Texts never travel: a path is
16 bytes a turn and has to fit a row.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.llm.store import written

#: Distinct paths that a shard should hold, and the least number of shards.
SHARD_PATHS = 50_000
LEAST_SHARDS = 24
#: Sampled paths for each splitter, and the turns that a splitter keeps at most (a splitter may be any path).
SAMPLED = 16
SPLITTER_TURNS = 128
#: Bytes of a node's name: the hash of its beginning. The root's name is empty.
NAME = 16
ROOT = b""
#: Ids in one piece of a list that is hashed.
PIECE_IDS = 4096
FLUSH_ROWS = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()


def own_paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path``: a conversation's turns in order, each as the hash of its role and text with the text's code points.

    Null roles and texts are empty; a null turn comes first; turns of one number are ordered by role, then by that hash.
    Rows without a conversation are left out, repeated rows are turns each.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    one = F.struct("turn", role.alias("role"), key.alias("key"), F.char_length(text).cast("long").alias("size"))
    return (
        turns.where(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("long"), one.alias("one"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
        .select("conv_id", F.transform("all", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("path"))
    )


def with_heads(paths: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Paths rebuilt: the first ``head`` turns (at most ``most``) of conversation ``base``, then what follows the own first ``head``.

    A base that is absent gives no turns.
    """
    named = paths.select("conv_id", "path", base.alias("base"), head.alias("head"))
    bases = named.where("conv_id = base").select("base", F.slice("path", 1, most).alias("of_base"))
    none = F.slice("path", 1, 0)
    return named.join(bases, "base", "left").select(
        "conv_id",
        F.concat(
            F.slice(F.coalesce("of_base", none), F.lit(1), F.col("head")),
            F.slice("path", F.col("head") + 1, F.greatest(F.size("path") - F.col("head"), F.lit(0))),
        ).alias("path"),
    )


def chained(paths: DataFrame) -> DataFrame:
    """``conv_id, path, sizes, end``: names of all beginnings in a row, their last texts' sizes, and the last name."""
    def run(batches):
        for batch in batches:
            turns = batch.column("path")
            keys = turns.flatten().field("key").to_pylist()
            sizes = turns.flatten().field("size").to_numpy(zero_copy_only=False).astype("<i8")
            stops = np.concatenate([[0], np.cumsum(turns.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            names, lengths = [], []
            for a, b in zip(stops, stops[1:]):
                name, chain = ROOT, []
                for key in keys[a:b]:
                    name = hashlib.md5(name + key, usedforsecurity=False).digest()
                    chain.append(name)
                names.append(b"".join(chain))
                lengths.append(sizes[a:b].tobytes())
            ends = [n[-NAME:] for n in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(names, pa.binary()), pa.array(lengths, pa.binary()), pa.array(ends, pa.binary())],
                ["conv_id", "path", "sizes", "end"],
            )

    return paths.mapInArrow(run, "conv_id long, path binary, sizes binary, end binary")


def members(paths: DataFrame) -> DataFrame:
    """``end, conv_id, n, ends_sha256``: of all conversations with one path the smallest, their number, and their ids' hash.

    Ids are sorted over the cluster and cut to pieces, so one task hashes pieces in turn and holds one of them at most.
    """
    def pieces(batches):
        held: list[int] = []
        name = None

        def piece():
            return (name, held[0], len(held), ",".join(map(str, held)))

        for batch in batches:
            out = []
            for end, conv_id in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held and (end != name or len(held) == PIECE_IDS):
                    out.append(piece())
                    held = []
                name = end
                held.append(conv_id)
            if out:
                yield _batch(out, PIECES)
        if held:
            yield _batch([piece()], PIECES)

    def hashes(batches):
        name = first = total = state = None
        for batch in batches:
            out = []
            for end, least, n, ids in zip(*(batch.column(c).to_pylist() for c in PIECES.names), strict=True):
                if end != name:
                    if name is not None:
                        out.append((name, first, total, state.hexdigest()))
                    name, first, total, state = end, least, n, hashlib.sha256(ids.encode())
                else:
                    total += n
                    state.update(b"," + ids.encode())
            if out:
                yield _batch(out, MEMBERS)
        if name is not None:
            yield _batch([(name, first, total, state.hexdigest())], MEMBERS)

    in_order = paths.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    cut = in_order.mapInArrow(pieces, "end binary, first long, n long, ids string")
    return cut.repartition("end").sortWithinPartitions("end", "first").mapInArrow(
        hashes, "end binary, conv_id long, n long, ends_sha256 string"
    )


PIECES = pa.schema([("end", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
MEMBERS = pa.schema([("end", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())])
NODES = pa.schema([
    ("name", pa.binary()), ("parent", pa.binary()), ("skeleton", pa.bool_()), ("size", pa.int64()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
])
NODES_DDL = (
    "name binary, parent binary, skeleton boolean, size long, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike: names are chained, so one comparison halves what is left."""
    low, high = 0, min(len(a), len(b)) // NAME
    while low < high:
        middle = (low + high + 1) // 2
        if a[(middle - 1) * NAME : middle * NAME] == b[(middle - 1) * NAME : middle * NAME]:
            low = middle
        else:
            high = middle - 1
    return low


def splitters(sample: list[bytes], count: int) -> list[bytes]:
    """At most ``count`` paths that part the sample evenly, each cut to where it differs from the one before it."""
    sample = sorted(sample)
    chosen = []
    for i in sorted({len(sample) * k // (count + 1) for k in range(1, count + 1)}) if sample else []:
        turns = (shared_turns(sample[i - 1], sample[i]) if i else 0) + 1
        chosen.append(sample[i][: turns * NAME])
    return sorted({c for c in chosen if c})


class Node:
    """An open node of a shard: what its members and finished children have given so far."""

    __slots__ = ("name", "parent", "depth", "size", "skeleton", "conv_id", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, name: bytes, parent: bytes | None, depth: int, size: int, skeleton: bool):
        self.name, self.parent, self.depth, self.size, self.skeleton = name, parent, depth, size, skeleton
        self.conv_id, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, None
        self.waiting: list[tuple] = []

    def has(self, conv_id: int, n: int) -> None:
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.n += n


def of_shard(paths: Iterator[tuple], skeleton: frozenset[bytes]) -> Iterator[tuple]:
    """Rows of NODES from one shard's sorted ``(path, sizes, conv_id, n, ends)``: finished nodes, and parts of skeleton nodes.

    A child waits for its parent's smallest member, unless that is a skeleton node, whose name it then carries.
    """
    stack = [Node(ROOT, None, 0, 0, True)]

    def under(parent: Node, row: tuple) -> Iterator[tuple]:
        if parent.skeleton:
            yield row
        else:
            parent.waiting.append(row)

    def close() -> Iterator[tuple]:
        node = stack.pop()
        if stack:
            stack[-1].has(node.conv_id, node.n)
        if node.skeleton:
            yield (node.name, node.parent, True, node.size, node.conv_id, node.depth, None, node.n, node.children, node.leaves, node.saved, node.ends)
            return
        for row in node.waiting:
            yield (*row[:6], node.conv_id, *row[7:])
        parent = stack[-1]
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        yield from under(parent, (
            node.name, node.parent, False, node.size, node.conv_id, node.depth, None, node.n, node.children, leaves, saved, node.ends or NO_ENDS
        ))

    def name_at(path: bytes, depth: int) -> bytes:
        return path[(depth - 1) * NAME : depth * NAME]

    previous, current = b"", next(paths, None)
    while current is not None:
        following = next(paths, None)
        path, packed, conv_id, n, ends = current
        sizes, depth = np.frombuffer(packed, dtype="<i8").tolist(), len(path) // NAME
        shared = shared_turns(previous, path)
        while len(stack) - 1 > shared:
            yield from close()
        # what no other path of the shard shares, and the skeleton doesn't hold, is a chain that is finished at once
        branching = max(len(stack) - 1, shared_turns(path, following[0]) if following else 0)
        while branching < depth and name_at(path, branching + 1) in skeleton:
            branching += 1
        for d in range(len(stack), branching + 1):
            name = name_at(path, d)
            stack.append(Node(name, stack[-1].name, d, sizes[d - 1], name in skeleton))
        top = stack[-1]
        top.has(conv_id, n)
        if depth == branching:
            top.ends = ends
        else:
            saved = (n - 1) * sum(sizes[branching:])
            top.children += 1
            top.leaves += 1
            top.saved += saved
            for d in range(branching + 1, depth + 1):
                last = d == depth
                row = (
                    name_at(path, d), name_at(path, d - 1) if d > 1 else ROOT, False, sizes[d - 1], conv_id, d,
                    None if d == branching + 1 else conv_id, n, int(not last), 1, saved, ends if last else NO_ENDS,
                )
                saved -= (n - 1) * sizes[d - 1]
                yield from under(top, row) if d == branching + 1 else (row,)
        previous, current = path, following
    while stack:
        yield from close()


def nodes(paths: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the paths (``conv_id, path``), from the root on.

    ``conv_id`` is the smallest member, ``n_convs`` the number of members, ``n_leaves`` of nodes without children in the
    subtree, ``saved_tokens`` what the subtree's texts would take again without sharing, ``ends_sha256`` the hash of the
    ids that end there. Without any conversation there is no node, not even a root.
    """
    spark = paths.sparkSession
    named = written(chained(paths))
    entries = written(members(named).join(named.select("conv_id", "path", "sizes"), "conv_id"))
    count = entries.count()
    n_shards = max(LEAST_SHARDS, -(-count // SHARD_PATHS))
    every = max(1, count // (n_shards * SAMPLED))
    sampled = entries.where(F.pmod(F.xxhash64("end"), F.lit(every)) == 0)
    # a bounded sample: SAMPLED paths a shard, cut to SPLITTER_TURNS
    sample = [bytes(r[0]) for r in sampled.select(F.substring("path", 1, SPLITTER_TURNS * NAME)).collect()]
    bounds = splitters(sample, n_shards - 1)
    skeleton = frozenset(b[i : i + NAME] for b in bounds for i in range(0, len(b), NAME))

    def deal(batches):
        for batch in batches:
            shards = [bisect.bisect_right(bounds, p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.int32())], [*batch.schema.names, "shard"])

    def rows_of(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "path", "sizes", "conv_id", "n", "ends_sha256"))
            yield from zip(*columns, strict=True)

    def finish(batches):
        rows = rows_of(batches)
        ahead = next(rows, None)
        while ahead is not None:
            shard = ahead[0]

            def own():
                nonlocal ahead
                while ahead is not None and ahead[0] == shard:
                    row, ahead = ahead, next(rows, None)
                    yield row[1:]

            out = []
            for row in of_shard(own(), skeleton):
                out.append(row)
                if len(out) == FLUSH_ROWS:
                    yield _batch(out, NODES)
                    out = []
            if out:
                yield _batch(out, NODES)

    columns = "conv_id long, end binary, n long, ends_sha256 string, path binary, sizes binary"
    dealt = entries.selectExpr("conv_id", "end", "n", "ends_sha256", "path", "sizes").mapInArrow(deal, f"{columns}, shard int")
    sorted_shards = dealt.repartition(n_shards, "shard").sortWithinPartitions("shard", "path")
    found = written(sorted_shards.mapInArrow(finish, NODES_DDL))
    parts = found.where("skeleton").groupBy("name", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.max("ends_sha256").alias("ends_sha256"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    # no more rows than the skeleton has nodes
    upper = spark.createDataFrame(rolled_up(parts.collect()), "name binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    parents = upper.select(F.col("name").alias("parent"), F.col("conv_id").alias("of_parent"))
    lower = (
        found.where("not skeleton").join(F.broadcast(parents), "parent", "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of_parent"))
    )
    return lower.select(*RESULT).unionByName(upper.select(*RESULT))


def rolled_up(parts: list) -> list[tuple]:
    """Skeleton nodes from their reduced parts: children that are skeleton nodes too are added from below."""
    by_name = {bytes(p["name"]): p for p in parts}
    below: dict[bytes, list[int]] = {name: [0, 0, 0] for name in by_name}
    out = []
    for part in sorted(parts, key=lambda p: -p["depth"]):
        children, leaves, saved = below[bytes(part["name"])]
        children += part["n_children"]
        leaves = leaves + part["n_leaves"] if children else 1
        saved += part["saved_tokens"] + (part["n_convs"] - 1) * part["size"]
        parent = None if part["parent"] is None else by_name[bytes(part["parent"])]
        if parent is not None:
            above = below[bytes(parent["name"])]
            above[0], above[1], above[2] = above[0] + 1, above[1] + leaves, above[2] + saved
        out.append((
            bytes(part["name"]), part["conv_id"], part["depth"], parent and parent["conv_id"], part["n_convs"],
            children, leaves, saved, part["ends_sha256"] or NO_ENDS,
        ))
    return out
