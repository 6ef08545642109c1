"""Jaccard self-join over word shingles by prefixes of token combinations.

Documents of equal sets are one entity. Tokens fall into two classes: frequent ones, of which there can be only so many,
and rare ones. A set of n tokens can miss at most ``t = n - ceil(threshold n)`` of them in any partner, so:

* its first t + 1 rare tokens are indexed one by one (tokens are ordered by their hash, rare ones first);
* with u <= t rare tokens, a partner that shares none of them misses all u, so the prefix is extended with frequent
  tokens, dealt into classes, whose pairs are indexed. A class of c tokens is only missed altogether if c - 1 of them
  are missing, so the extension ends where these numbers exceed t - u.

Entities that share an index entry are candidates, unless sizes and rare tokens already tell. Where many share one, all
are first compared with its pivot, the entity of fewest rare tokens, and only what is still apart after that is compared
pair by pair. A sketch of set parities discards most candidates, the others are verified on whole sets. Every link is found, or its ends are
connected by other links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.llm import bpe
from cipherledger.llm.components import components
from cipherledger.llm.shingles import mixed, parities, shingle_sets
from cipherledger.llm.store import written

#: A token is frequent if it stands for at least this part of all tokens; so there are at most as many.
FREQUENT = 2**20
#: Tokens are counted in runs of this many: at least twice as many as above, or a token of that share may stand once in each.
RUN = 2**21
#: Rows that Python workers get at once: a pair to compare holds two whole sets.
BATCH_ROWS = 512
#: Bits of the filter that picks the documents to verify; documents let through in vain only cost time.
FILTER_BITS = 2**27
#: Entries that more entities share go by their pivot first.
MANY = 64


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def _sets(batch: pa.RecordBatch, column: int, n_words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of a batch: where they begin, and their texts' sets."""
    begin = 0
    for some in bpe.slices(batch):
        texts = some.column(column).to_pylist()
        for a, b in bpe.runs(texts):
            yield begin + a, shingle_sets([t.encode("utf-8").lower() for t in texts[a:b]], n_words)
        begin += len(texts)


def _keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two hashes of each set."""
    sums = ([s.sum(dtype=np.uint64) for s in sets], [mixed(s * s + np.uint64(1)).sum(dtype=np.uint64) for s in sets])
    return [pa.array(np.array(own, dtype=np.uint64).view(np.int64), pa.int64()) for own in sums]


def _bars(counted: DataFrame) -> tuple[int, int]:
    """How often a listed and a frequent token stand at least.

    As few times as list no more tokens than can be of great share; frequent are those of that share, and already those
    in more than ``MANY`` places if they are listed.
    """
    share = max(2, math.ceil((counted.agg(F.sum("total")).first()[0] or 0) / FREQUENT))
    held = counted.where("n > 1").groupBy(F.length(F.bin("n")).alias("bits")).count().orderBy(F.desc("bits")).collect()
    listed, room = share, FREQUENT
    for row in held:
        room -= row["count"]
        if room >= 0:
            listed = min(listed, 2 ** (row.bits - 1))
    return listed, min(share, max(listed, MANY + 1))


def frequent_tokens(docs: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that stand often, sorted, and each one's rank from the seldomest; frequent are those from 0 on.

    What is missed here is handled as rare, or comes earlier in the order of tokens: only more slowly. A token of great
    share has it in some run, so runs report only what is frequent within them.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(held: list[np.ndarray]) -> pa.RecordBatch:
            tokens = np.concatenate([np.zeros(0, dtype=np.uint64), *held])
            held.clear()
            tokens.sort()
            least = max(2, math.ceil(len(tokens) / FREQUENT))
            often = np.unique(tokens[: 1 - least][tokens[least - 1 :] == tokens[: 1 - least]])
            counts = np.searchsorted(tokens, often, side="right") - np.searchsorted(tokens, often)
            # one row more tells how many tokens there were
            columns = [np.append(often.view(np.int64), 0), np.append(counts, 0), np.append(np.zeros(len(often), np.int64), len(tokens))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "n", "total"])

        held: list[np.ndarray] = []
        size = 0
        for batch in bpe.small(batches):
            for _, sets in _sets(batch, 0, n_words):
                held += sets
                size += sum(map(len, sets))
                if size >= RUN:
                    yield report(held)
                    size = 0
        yield report(held)

    counted = written(
        _rows(docs).select("text").mapInArrow(count, "token long, n long, total long")
        .groupBy("token").agg(F.sum("n").alias("n"), F.sum("total").alias("total")),
        BATCH_ROWS,
    )
    listed, bar = _bars(counted)
    found = counted.where(F.col("n") >= listed).select("token", "n").toArrow()
    tokens, counts = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    ranks = np.empty(len(tokens), dtype=np.int32)
    ranks[np.lexsort((tokens, counts))] = np.arange(len(tokens)) - np.count_nonzero(counts < bar)
    order = np.argsort(tokens)
    return tokens[order], ranks[order]


def combinations(frequent: np.ndarray, n: int, threshold: int, spare: int) -> np.ndarray:
    """Index entries of a set's frequent tokens: pairs within classes of an extended prefix.

    ``frequent``: these tokens in an order that all sets share; ``n``: size of the set; ``spare``: how many of its frequent tokens it may miss at most. The number of classes goes
    by the power of two below n alone; a set just above one is indexed for smaller partners as well.
    """
    out = []
    level = n.bit_length() - 1
    levels = [level, level - 1] if n * threshold <= 100 * 2**level else [level]
    for own in levels:
        n_classes = max(1, 2**own * (100 - threshold) // 400)
        classes = (frequent >> np.uint64(20)) % np.uint64(n_classes)
        order = np.argsort(classes, kind="stable")
        # position of each token within its class, in the order of tokens
        inside = np.empty(len(frequent), dtype=np.int64)
        sorted_classes = classes[order]
        inside[order] = np.arange(len(frequent)) - np.searchsorted(sorted_classes, sorted_classes)
        needed = np.searchsorted(np.cumsum(inside > 0), spare + 1) + 1
        prefix, prefix_classes = frequent[:needed], classes[:needed]
        for c in np.unique(prefix_classes):
            tokens = prefix[prefix_classes == c]
            left, right = np.triu_indices(len(tokens), 1)
            out.append(mixed(tokens[left] + mixed(tokens[right] + np.uint64(own))))
    return np.concatenate(out)


def entries(
    shingles: np.ndarray, listed: np.ndarray, threshold: int, ranks: np.ndarray | None = None
) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rare tokens, rare index entries, frequent index entries of one set.

    Tokens come in the order of their ranks, those not listed first, so that few sets share the first ones. Frequent are
    those of rank 0 or more (``ranks`` None: all that are listed).
    """
    n = len(shingles)
    missing = n * (100 - threshold) // 100
    at = np.minimum(np.searchsorted(listed, shingles), max(len(listed) - 1, 0))
    own = np.full(n, -len(listed) - 1, dtype=np.int64)
    known = listed[at] == shingles if len(listed) else np.zeros(n, dtype=bool)
    own[known] = 0 if ranks is None else ranks[at[known]]
    order = np.argsort(own, kind="stable")
    n_rare = int(np.searchsorted(own[order], 0))
    rare, often = shingles[order[:n_rare]], shingles[order[n_rare:]]
    if len(rare) > missing:
        return len(rare), rare[: missing + 1], shingles[:0]
    if n < 2:  # nothing but an equal set is near to one token
        return len(rare), rare, shingles[:0]
    return len(rare), rare, combinations(often, n, threshold, missing - len(rare))


def index(docs: DataFrame, n_words: int, threshold: int) -> DataFrame:
    """One row per document: size, number of rare tokens, 128-bit key of the set, sketch, index entries."""
    listed, ranks = frequent_tokens(docs, n_words)
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.small(batches):
            for a, sets in _sets(batch, 1, n_words):
                found = [entries(s, listed, threshold, ranks) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(sets)),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([f[0] for f in found], pa.int32()),
                        *_keys(sets),
                        pa.array([parities(s) for s in sets], longs),
                        pa.array([f[1].view(np.int64) for f in found], longs),
                        pa.array([f[2].view(np.int64) for f in found], longs),
                    ],
                    ["doc_id", "n", "u", "high", "low", "sketch", "rare", "often"],
                )

    schema = "doc_id long, n int, u int, high long, low long, sketch array<long>, rare array<long>, often array<long>"
    return _rows(docs).mapInArrow(run, schema)


def _named(rows: DataFrame, side: str, *shared: str) -> DataFrame:
    """Columns with a suffix, but for the shared ones."""
    return rows.select(*[F.col(c) if c in shared else F.col(c).alias(f"{c}_{side}") for c in rows.columns])


def _possible(threshold: int) -> Column:
    """Whether sizes (n) and rare tokens (u) let two sets be near enough.

    An entry's lowest bit tells that it is made of frequent tokens. Two sets that share a rare token have an entry for
    that; else they differ in all their rare tokens.
    """
    often = F.col("entry").bitwiseAND(1) == 1
    apart = F.when(
        often, F.col("u_a") + F.col("u_b") + F.abs(F.col("n_a") - F.col("u_a") - F.col("n_b") + F.col("u_b"))
    ).otherwise(F.abs(F.col("n_a") - F.col("n_b")))
    return apart <= _most_apart(threshold)


def _most_apart(threshold: int) -> Column:
    """Elements in which two near sets may differ: the intersection is at least t / (100 + t) of the sum of sizes."""
    both = F.col("n_a") + F.col("n_b")
    return both - 2 * F.ceil(both * threshold / (100 + threshold))


def _pairs(both: DataFrame) -> DataFrame:
    """``a, b`` with a < b, each once."""
    least, most = F.least("entity_a", "entity_b"), F.greatest("entity_a", "entity_b")
    return both.select(least.alias("a"), most.alias("b")).where("a <> b").distinct()


def _alike(threshold: int) -> Column:
    """Whether sketches let two sets be near enough."""
    def halved(longer: str, other: str) -> Column:
        """A sketch brought to the other's length; near sets are at most a power of two apart."""
        half = F.size(other)
        twice = F.zip_with(F.slice(longer, F.lit(1), half), F.slice(longer, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(longer) > half, twice).otherwise(F.col(longer))

    differing = F.zip_with(
        halved("sketch_a", "sketch_b"), halved("sketch_b", "sketch_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))
    )
    return F.aggregate(differing, F.lit(0), lambda total, x: total + x) <= _most_apart(threshold)


def _near(pairs: DataFrame, entities: DataFrame, threshold: int) -> DataFrame:
    """Pairs that sketches don't rule out."""
    for side in "ab":
        own = entities.select(F.col("entity").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        pairs = pairs.join(own, side)
    return pairs.where(_alike(threshold)).select("a", "b")


def _sets_of(docs: DataFrame, wanted: DataFrame, n_words: int) -> DataFrame:
    """``entity, tokens``: the sets of the wanted entities, each once, made again from their texts.

    A filter of bounded size over the wanted ids goes to the texts, so that no text is shuffled; the join decides.
    """
    bits = min(FILTER_BITS, 1 << max(16, (16 * wanted.count()).bit_length()))

    def cells(ids: str) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(k), F.col(ids)), F.lit(bits)) for k in range(2)]

    words = (
        wanted.select(F.explode(F.array(*cells("doc_id"))).alias("cell"))
        .groupBy(F.shiftright("cell", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, int(cell & 7))")).alias("held"))
        .toArrow()
    )
    held = np.zeros(bits // 8, dtype=np.uint8)
    held[words.column(0).to_numpy()] = words.column(1).to_numpy()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.small(batches):
            marked = [held[c >> 3] >> (c & 7) & 1 for c in (batch.column(k).to_numpy() for k in (2, 3))]
            batch = batch.filter(pa.array((marked[0] & marked[1]).astype(bool)))
            for a, sets in _sets(batch, 1, n_words):
                yield pa.RecordBatch.from_arrays(
                    [*_keys(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["high", "low", "tokens"]
                )

    first, second = cells("doc_id")
    made = _rows(docs).select("doc_id", "text", first.alias("first"), second.alias("second")).mapInArrow(
        collect, "high long, low long, tokens binary"
    )
    # an id may stand for several texts, and a text may be repeated; an entity is what has its key
    return made.dropDuplicates(["high", "low"]).join(wanted, ["high", "low"]).select("entity", "tokens")


def _verified(pairs: DataFrame, entities: DataFrame, docs: DataFrame, n_words: int, threshold: int) -> DataFrame:
    """Pairs whose whole sets are near enough."""
    pairs = written(pairs)
    if pairs.isEmpty():
        return pairs
    needed = pairs.select(F.col("a").alias("entity")).union(pairs.select("b")).distinct()
    wanted = written(entities.join(needed, "entity").select("entity", "doc_id", "high", "low"))
    sets = written(_sets_of(docs, wanted, n_words), BATCH_ROWS)
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("entity").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.small(batches):
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                left, right = (np.frombuffer(t.as_buffer(), dtype=np.uint64) for t in (x, y))
                shared = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(100 * shared >= threshold * (len(left) + len(right) - shared))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return written(pairs.select("a", "b", "tokens_a", "tokens_b").mapInArrow(compare, "a long, b long").distinct(), BATCH_ROWS)


def _members(entities: DataFrame) -> DataFrame:
    """``entry, held, entity, u, n`` of the index entries that several entities share."""
    rare, often = (
        entities.select("entity", F.explode(column).alias("own")).select(
            "entity", F.col("own").bitwiseAND(-2).bitwiseOR(bit).alias("entry"))
        for bit, column in enumerate(("rare", "often"))
    )
    listed = rare.union(often)
    shared = written(listed.groupBy("entry").agg(F.count("*").alias("held")).where("held > 1"))
    return written(listed.join(shared, "entry").join(entities.select("entity", "u", "n"), "entity"))


def _first_pairs(members: DataFrame, threshold: int) -> DataFrame:
    """All pairs of entries that few share; of the others, each entity with the pivot."""
    few = members.where(F.col("held") <= MANY).drop("held")
    both = _named(few, "a", "entry").join(_named(few, "b", "entry"), "entry").where("entity_a < entity_b")
    many = members.where(F.col("held") > MANY).drop("held")
    pivot = written(many.groupBy("entry").agg(F.min(F.struct("u", "entity", "n")).alias("first")))
    stars = _named(many, "a", "entry").join(_named(pivot.select("entry", "first.*"), "b", "entry"), "entry")
    return _pairs(both.unionByName(stars).where(_possible(threshold)))


def _still_apart(members: DataFrame, reached: DataFrame, entities: DataFrame, threshold: int) -> DataFrame:
    """Pairs of entities that share an entry with many, lie in different components, and may be near.

    Entities of an entry are taken together by size and rare tokens; only classes that may be near are unfolded.
    """
    # by entity first, not for every entry that an entity shares with many
    known = entities.join(reached, F.col("entity") == F.col("node"), "left").select(
        "entity", "sketch", F.coalesce("component", "entity").alias("component")
    )
    placed = written(members.where(F.col("held") > MANY).drop("held").join(known, "entity"))
    classes = placed.groupBy("entry", "u", "n").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    possible = _named(classes, "a", "entry").join(_named(classes, "b", "entry"), "entry").where(
        (F.struct("n_a", "u_a") <= F.struct("n_b", "u_b"))
        & (F.least("least_a", "least_b") < F.greatest("most_a", "most_b"))
        & _possible(threshold)
    ).select("entry", "u_a", "n_a", "u_b", "n_b")
    return _pairs(
        possible.join(_named(placed, "a", "entry"), ["entry", "u_a", "n_a"])
        .join(_named(placed, "b", "entry"), ["entry", "u_b", "n_b"])
        .where((F.col("component_a") != F.col("component_b")) & _alike(threshold))
    )


def join(docs: DataFrame, n_words: int, threshold: int) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest doc_id that links reach from each document, its own included.

    Two documents are linked if 100 x intersection >= threshold x union of their sets of distinct n-word shingles (with
    fewer words, the whole sequence as one; A-Z lower-cased, words between ASCII white space). Null texts and texts
    without words have an empty set, linked with nothing. Every row gets its row back: equal rows share a component, and
    a row without an id takes its component's least id, or null. Other columns are left out.
    """
    if not 50 < threshold <= 100:
        raise ValueError("the threshold is a whole percentage over 50")
    rows = written(index(docs, n_words, threshold), BATCH_ROWS)
    entities = written(
        rows.where("n > 0").groupBy("high", "low").agg(
            F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "u", "sketch", "rare", "often")]
        ).withColumn("entity", F.monotonically_increasing_id())
    )
    members = _members(entities)

    def linked(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, entities, docs, n_words, threshold)

    links = linked(_near(_first_pairs(members, threshold), entities, threshold))
    more = linked(_still_apart(members, components(links), entities, threshold))
    reached = components(links.union(more))
    grouped = written(
        entities.join(reached, F.col("entity") == F.col("node"), "left")
        .select("high", "low", "doc_id", F.coalesce("component", "entity").alias("component"))
    )
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = written(grouped.join(least, "component").select("high", "low", "component_id"))
    return rows.join(named, ["high", "low"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
