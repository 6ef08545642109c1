"""Line dedup, Jaccard join, searches, sharding and the pipeline: brute force, odd rows, empty tables."""

import heapq
import os
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cipherledger.llm import bpe, jaccard, languages, lines, mtree, neighbours, queries, secrets, sharding, shingles, vectors
from cipherledger.llm.components import components
from tests.llm.conftest import SF


def plain_line_dedup(docs):
    """{id: text} without the lines of later three-line windows."""
    seen, out = set(), {}
    for doc_id in sorted(docs):
        own = docs[doc_id].split("\n")
        gone = set()
        for i in range(len(own) - 2):
            window = tuple(own[i : i + 3])
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        out[doc_id] = "\n".join(x for i, x in enumerate(own) if i not in gone)
    return out


def test_lines_by_brute_force(spark, documents):
    made = {i: "\n".join(random.Random(i).choices("abc", k=i % 9)) for i in range(60)}
    rows = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup(rows).collect()} == plain_line_dedup(made)
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert {r.doc_id: r.text for r in lines.dedup(documents).collect()} == plain_line_dedup(texts)


def test_lines_odd_rows(odd_docs, no_docs):
    rows = lines.dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_removed == 0 and by_id[2].text == "other" and by_id[3].text is None and by_id[3].n_lines == 0
    assert by_id[5].n_lines == 12001 and by_id[5].text.count("\n") < 5 and by_id[1].entity == "e"
    assert lines.dedup(no_docs).count() == 0
    both = lines.dedup(odd_docs.where("doc_id = 1").union(odd_docs.where("doc_id = 1"))).collect()
    assert {r.n_removed for r in both} == {0}  # rows of one id and text are one document


# ---- Jaccard join


def plain_components(docs, n, threshold):
    def words(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = lower.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        return [w for w in found if w]

    sets = []
    for _, text in docs:
        own = words(text)
        sets.append({tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if len(own) >= n else {tuple(own)} if own else set())
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= threshold * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return {doc_id: (len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(docs)}


def near_copies(seed, groups, copies, size):
    """Groups of texts with a few words changed, their passages shared, and short ones."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(size // 2)]
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(60 * size)}" for _ in range(size)]
        if g % 2:
            base[: len(passage)] = passage
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(size)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(own[: rng.choice([size, size, size - 3])]))
    return [(i * 3 + 1, t) for i, t in enumerate(texts + ["a b", "A b", "a", "", "a b c d e f g"])]


@pytest.mark.parametrize("n,threshold,often", [(3, 90, 2**20), (3, 90, 300), (5, 80, 300), (1, 60, 60)])
def test_components_by_brute_force(spark, monkeypatch, n, threshold, often):
    """With a low bar for frequent tokens, most sets are indexed by combinations."""
    monkeypatch.setattr(jaccard, "FREQUENT", often)
    docs = near_copies(often, 8, 12, 80)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(rows, n, threshold).collect()}
    assert got == plain_components(docs, n, threshold)


def test_workers_of_the_join_get_few_rows_at_once(spark, monkeypatch):
    """A pair to compare holds two whole sets; a run tells every token of the share that makes it frequent."""
    asked, write = [], jaccard.written

    def spy(df, batch_rows=None):
        if "MapInArrow" in df._jdf.queryExecution().executedPlan().toString():
            asked.append(batch_rows)
        return write(df, batch_rows)

    monkeypatch.setattr(jaccard, "written", spy)
    docs = near_copies(5, 4, 6, 60)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(rows, 3, 90).collect()}
    assert got == plain_components(docs, 3, 90)
    assert len(asked) >= 4 and {n is not None and n <= 1024 for n in asked} == {True}
    assert jaccard.RUN >= 2 * jaccard.FREQUENT


def test_documents_by_brute_force(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_jaccard(spark, SF).collect()}
    assert got == plain_components(docs, 3, 90)


def test_near_sets_share_an_entry():
    """Any two sets near enough share an index entry, whichever of their tokens are frequent."""
    rng = np.random.default_rng(1)
    for trial in range(300):
        size = int(rng.choice([rng.integers(2, 30), rng.integers(10, 300)]))
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        missing = len(base) * 10 // 100
        drop = int(rng.integers(0, missing + 1))
        other = np.unique(np.append(rng.permutation(base)[drop:], rng.integers(0, 2**63, int(rng.integers(0, missing // 2 + 1)), dtype=np.uint64)))
        shared = len(np.intersect1d(base, other))
        if 100 * shared < 90 * (len(base) + len(other) - shared) or len(base) == len(other) == shared:
            continue
        every = np.union1d(base, other)
        frequent = np.sort(rng.permutation(every)[: int(len(every) * rng.choice([0, 0.3, 0.9, 1.0]))])
        mine, yours = (jaccard.entries(s, frequent, 90) for s in (base, other))
        assert np.intersect1d(mine[1], yours[1]).size or np.intersect1d(mine[2], yours[2]).size, trial


def test_near_sets_share_an_entry_in_the_order_of_ranks():
    """As above, with tokens ordered by how seldom they stand; sets that share the most frequent tokens alone are no candidates."""
    rng = np.random.default_rng(2)
    for trial in range(300):
        base = np.unique(rng.integers(0, 2**63, int(rng.integers(10, 300)), dtype=np.uint64))
        drop = int(rng.integers(0, len(base) // 10 + 1))
        other = np.unique(np.append(rng.permutation(base)[drop:], rng.integers(0, 2**63, int(rng.integers(0, len(base) // 20 + 1)), dtype=np.uint64)))
        shared = len(np.intersect1d(base, other))
        if 100 * shared < 90 * (len(base) + len(other) - shared) or len(base) == len(other) == shared:
            continue
        every = np.union1d(base, other)
        listed = np.sort(rng.permutation(every)[: int(len(every) * rng.choice([0.3, 0.9, 1.0]))])
        ranks = rng.permutation(len(listed)) - int(len(listed) * rng.choice([0, 0.3, 0.9, 1.0]))
        mine, yours = (jaccard.entries(s, listed, 90, ranks) for s in (base, other))
        assert np.intersect1d(mine[1], yours[1]).size or np.intersect1d(mine[2], yours[2]).size, trial
    passage, others = np.arange(60, dtype=np.uint64), np.arange(100, 180, dtype=np.uint64)
    listed = np.concatenate([passage, others])
    ranks = np.append(np.arange(60) + 80, np.arange(80))  # tokens of the passage are the most frequent ones
    one, two = (jaccard.entries(np.append(passage, o), listed, 80, ranks)[2] for o in (others[:40], others[40:]))
    assert one.size and two.size and not np.intersect1d(one, two).size


def test_common_phrases_make_no_large_entries(spark, monkeypatch):
    """Texts that have but a phrase in common are no candidates, though its tokens are far from a great share of all."""
    monkeypatch.setattr(jaccard, "FREQUENT", 500)
    monkeypatch.setattr(jaccard, "MANY", 4)
    rng = random.Random(3)
    docs = []
    for i in range(80):
        own = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        own[40:48] = [f"phrase{i // 10}-{k}" for k in range(8)]
        docs += [(2 * i, " ".join(own))] + ([(2 * i + 1, " ".join(own[:95]))] if i % 20 == 0 else [])
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    entities = jaccard.index(rows, 3, 80).withColumn("entity", F.col("doc_id"))
    assert entities.agg(F.sum("n")).first()[0] > 500 * 12  # ten of a phrase's token are no great share
    members = jaccard._members(entities)
    assert members.where("held > 4").count() == 0 and members.where("held > 1").count() > 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(rows, 3, 80).collect()}
    assert got == plain_components(docs, 3, 80)


def test_listed_tokens_are_bounded(spark, monkeypatch):
    """As many tokens are listed as have room, those that stand most often first."""
    monkeypatch.setattr(jaccard, "FREQUENT", 10)
    counts = [0] + [2] * 50 + [5] * 4 + [9] * 3 + [200] * 2
    counted = spark.createDataFrame([(i, n, 0 if i else 10_000) for i, n in enumerate(counts)], "token long, n long, total long")
    assert jaccard._bars(counted) == (4, 65)
    monkeypatch.setattr(jaccard, "FREQUENT", 1000)
    assert jaccard._bars(counted) == (2, 10)


def test_jaccard_odd_rows(odd_docs, no_docs):
    rows = jaccard.join(odd_docs, 3, 90).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert by_id[3] == (0, 3) and by_id[9] == (0, 9) and by_id[7] == (2, 7) and by_id[6] == (1, 6)
    assert jaccard.join(no_docs, 3, 90).count() == 0


def test_sets_to_verify_stand_once(spark):
    """Repeated rows must not meet each other's repeats."""
    rows = spark.createDataFrame([(1, "a b c d e")] * 40 + [(None, "f g h i")] * 30 + [(1, "k l m n")], "doc_id long, text string")
    wanted = jaccard.index(rows, 3, 90).groupBy("high", "low").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("entity"))
    made = jaccard._sets_of(rows, wanted.where("entity > 2 OR doc_id IS NULL"), 3).collect()
    assert sorted((r.entity, len(r.tokens)) for r in made) == [(2, 16), (3, 24)]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (201, 200)]
    rows = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(rows[i] == 0 for i in range(1, 41)) and all(rows[i] == 100 for i in range(101, 150)) and rows[201] == 200


def test_shingle_hashes_follow_words():
    texts = [b"a b c d", b"", b" x  y ", b"a b c", b"b c d\na b c", b"q"]
    sets = shingles.shingle_sets(texts, 3)
    assert [len(s) for s in sets] == [2, 0, 1, 1, 4, 1]
    assert sets[3][0] in sets[0] and sets[3][0] in sets[4]


# ---- searches


def plain_search(rows, step, k, measure, skip_zero):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (any(v) or not skip_zero)]
    asked = {}
    for i, v in good:
        if i % step == 0:
            asked[i] = min(v, asked.get(i, v))
    out = {}
    for q, v in asked.items():
        near = sorted((-measure(v, w), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def whole_product(v, w):
    return sum(int(np.floor(1024 * a)) * int(np.floor(1024 * b)) for a, b in zip(v, w, strict=True))


def product(v, w):
    return float((np.array(v) * np.array(w)).sum())


@pytest.mark.parametrize("run,step,k,measure,skip_zero", [
    (mtree.top_k, 100, 10, whole_product, False), (neighbours.nearest, 20, 20, product, True),
])
def test_searches_by_brute_force(spark, vectors, run, step, k, measure, skip_zero):
    plain = [(r.vec_id, r.embedding) for r in vectors.collect()]
    sample = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    for rows, own in ((vectors, plain), (sample, [(r.vec_id, r.embedding) for r in sample.collect()])):
        got = {}
        for r in run(rows, rows.where(f"vec_id % {step} = 0"), k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
            assert r["rank"] == len(got[r.query_id])
        want = {q: v for q, v in plain_search(own, step, k, measure, skip_zero).items() if v}
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
        assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12) for q in want)
    assert run(vectors.limit(0), vectors.limit(0), k).count() == 0


def test_copies_of_a_vector_leave_blocks_bounded(spark):
    rows = spark.createDataFrame([(1, [9.0, 9.0])] * 3000 + [(i, [1.0, i / 100]) for i in range(2, 50)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id = 2")
    assert [r.vec_id for r in mtree.top_k(rows, asked, 5).collect()] == [1] * 5
    sizes = vectors.search(
        vectors.usable(rows), vectors.once_each(vectors.usable(asked)), 5, lambda ids, _: len(ids),
        lambda size, own: pd.DataFrame({"query_id": own[0], "vec_id": own[0], "score": size}), "long",
    )
    assert sizes.agg(F.max("score")).first()[0] <= 5 + 48


def test_many_equal_vectors_take_little_memory():
    rows = np.tile(np.linspace(-1, 1, 64), (2048, 1))
    block = neighbours.quantise(np.arange(2048), rows)
    asked = neighbours.quantise(np.arange(5000, 5128), rows[:128])
    tracemalloc.start()
    heaps = neighbours.best(block, asked, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(sorted(-i for _, i in h) == list(range(20)) for h in heaps)
    assert peak < 100_000_000


def test_tree_search_equals_a_scan():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (6, 12))
    values = centres[rng.integers(0, 6, 3000)] + rng.integers(-20, 20, (3000, 12))
    values[500:900] = values[500]
    tree = mtree.build(np.arange(3000), values)
    for q in (0, 500, 2999):
        want = sorted((-int(s), i) for i, s in enumerate(values @ values[q]) if i != q)[:10]
        assert sorted((-s, -i) for s, i in mtree.best(tree, q, values[q], 10)) == want


# ---- sharding


def test_shards_by_a_plain_heap(spark, documents):
    rows = sharding.shard(documents, 5).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    groups = {}
    for text in texts.values():
        groups[text] = groups.get(text, 0) + len(text.encode()) + 16
    heap = [(0, s) for s in range(5)]
    for size in sorted(groups.values(), reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    loads, shard_of = {}, {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        shard_of.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    assert max(loads.values()) <= 1.003 * max(load for load, _ in heap)
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_small_groups_are_levelled_in_batches(spark):
    rows = spark.range(20_000).select("id", F.repeat(F.concat(F.col("id").cast("string"), F.lit("x")), (F.col("id") % 11).cast("int")).alias("text"))
    loads = sharding.shard(rows.withColumnRenamed("id", "doc_id"), 7).groupBy("shard").agg(F.sum("size").alias("load")).toPandas().load
    assert len(loads) == 7 and loads.max() <= 1.005 * loads.min()


def test_sharding_odd_rows(odd_docs, no_docs):
    rows = sharding.shard(odd_docs, 40).collect()
    assert len(rows) == odd_docs.count() and {r.size for r in rows if r.doc_id in (3, 4)} == {16}
    assert {r.text_crc32 for r in rows if r.doc_id in (3, 4)} == {0}
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1
    assert sharding.shard(no_docs, 40).count() == 0


def test_components_are_looked_up_by_entity_not_by_entry(spark, monkeypatch):
    members = spark.createDataFrame([(e, 70, i, 0, 9) for e in range(30) for i in range(70)], "entry long, held long, entity long, u int, n int")
    entities = spark.createDataFrame([(i, 9, [i]) for i in range(70)], "entity long, n int, sketch array<long>")
    reached = spark.createDataFrame([(i, 0) for i in range(1, 69)], "node long, component long")
    joins, write = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df: joins.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    found = jaccard._still_apart(members, reached, entities, 80)
    assert {(r.a, r.b) for r in found.collect()} == {(i, 69) for i in range(69) if (i ^ 69).bit_count() <= 2}
    outer = joins[0].split("LeftOuter")[1]
    assert joins[0].count("Join ") == 2 and "sketch" in outer and "entry" not in outer


# ---- SQL twins and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*[d[0] for d in want.description])
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


def test_pipeline_stage_by_stage(spark, documents):
    docs, taken = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF))
        taken[name] = ({r.doc_id: r.text for r in before.collect()}, docs)
    texts, kept = taken["language"]
    assert kept.count() >= 0.99 * len(texts)
    texts, kept = taken["line_dedup"]
    want = {i: t for i, t in plain_line_dedup(texts).items() if t or not texts[i]}
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {i: (t, len(t)) for i, t in want.items()}
    texts, kept = taken["near_duplicates"]
    groups = plain_components(sorted(texts.items()), 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    texts, kept = taken["secrets"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(texts)
    assert kept.columns == documents.columns
    assert not kept.where("text rlike 'AKIA[A-Z0-9]{16}'").count()
    texts, packed = taken["packing"]
    assert {r.doc_id for r in packed.collect()} == set(texts)


def test_pipeline_odd_rows(spark, odd_docs, no_docs):
    for rows in (odd_docs, no_docs):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.count() >= rows.limit(1).count()


def test_pipeline_models_are_those_of_all_documents(spark, documents, monkeypatch):
    for module, name in ((languages, "TRAIN_DOCS"), (languages, "TRAIN_DOCS_EACH"), (secrets, "SAMPLE_DOCS")):
        monkeypatch.setattr(module, name, 10**9)
    fitted = languages.train(documents.where(~queries.held_out()))
    model = secrets.train_on(documents)
    for module, name in ((languages, "TRAIN_DOCS"), (languages, "TRAIN_DOCS_EACH"), (secrets, "SAMPLE_DOCS")):
        monkeypatch.setattr(module, name, 1)
    monkeypatch.setattr(languages, "recognised", lambda docs, own: docs.limit(0) if (own.weights == fitted.weights).all() else None)
    monkeypatch.setattr(secrets, "redact", lambda docs, own: docs.limit(0) if (own == model).all() else None)
    assert corpus_pipeline.language(spark, documents, SF).count() == 0
    assert corpus_pipeline.mask_secrets(spark, documents, SF).count() == 0


def test_pipeline_packs_the_tokens_themselves(spark, documents):
    some = documents.limit(40)
    rows = corpus_pipeline.pack(spark, some, SF).collect()
    assert {r.sequence_id is not None and len(r.ids) == 4 * r.length for r in rows} == {True}
    want = {r.doc_id: bytes(r.ids) + bytes(4) for r in bpe.encode(some, queries.VOCABULARY).collect()}
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    assert got == want


def test_entry_registers_all_operators():
    import __spark_entry__

    assert [n for n in range(1, 11) if any(q.startswith(f"op{n}_") for q in __spark_entry__.queries())] == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries() and os.path.exists(SF)
