"""The numbered operators as queries over the whole tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.llm import (
    bpe,
    jaccard,
    languages,
    licenses,
    lines,
    mtree,
    neighbours,
    packing,
    prefix_counts,
    secrets,
    sharding,
    trie,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(run: Callable[[SparkSession, str], DataFrame]):
    """Register a query under its function's name."""
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; hashes of both."""
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY), VOCABULARY)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 tokens."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), VOCABULARY, 2048)
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 2048)


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with models trained on what the fixed shapes label."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train_on(docs))

    def of(kind: str):
        return F.filter("spans", lambda s: s["kind"] == kind)

    def places(spans):
        shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(shown, ",")

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(places(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        places(F.col("spans")).alias("spans"),
        F.size(of("random")).cast("long").alias("n_random"),
    )


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence signatures of every document."""
    base = F.filter("detections", lambda d: d["rule"].startswith("base:"))

    def labels(detections):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")

    missing = F.aggregate("detections", F.lit(1.0), lambda left, d: left * (1 - d["weight"]))
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        (1 - missing).alias("score"),
    )


def held_out() -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@query
def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = languages.train(docs.where(~held_out()))
    return languages.identify(docs, model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous"
    )


@query
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten largest integer inner products of every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return mtree.top_k(rows, rows.where("vec_id % 100 = 0"), 10)


@query
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest of every twentieth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 20 = 0"), 20)


ORACLES["op4_top_k"] = """
WITH rows AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of about equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that three-line windows show to stand elsewhere before."""
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


ORACLES["op2_line_dedup"] = """
WITH cut AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos
    FROM documents
), windows AS (
    SELECT doc_id, pos, line, lead(line, 1) OVER w AS second, lead(line, 2) OVER w AS third
    FROM cut WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
    SELECT doc_id, pos FROM windows WHERE third IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, pos) > 1
), covered AS (
    SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS t(k)
), judged AS (
    SELECT cut.*, covered.pos IS NOT NULL AS gone FROM cut LEFT JOIN covered USING (doc_id, pos)
)
SELECT d.doc_id,
       CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') END AS text,
       count(pos)::INTEGER AS n_lines, (count(*) FILTER (WHERE gone))::INTEGER AS n_removed
FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id
GROUP BY d.doc_id, d.text
"""


@query
def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose three-word shingles are equal by nine tenths."""
    return jaccard.join(table(spark, sf_dir, "documents"), 3, 90)


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, from the tables of its prefixes."""
    counted = prefix_counts.count_prefixes(table(spark, sf_dir, "documents"), VOCABULARY)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 components of largest variance, to unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 32)


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: each begins with up to five turns of its hundred's first."""
    turns = table(spark, sf_dir, "conversations")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    rebuilt = trie.with_heads(trie.own_paths(turns), F.col("conv_id") - F.col("conv_id") % 100, head, 5)
    return trie.nodes(rebuilt).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


ORACLES["op12_prefix_trie"] = """
WITH own AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns,
        list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))
        ) AS crc
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
    SELECT *, (xor(crc, 4294967295) % 6)::BIGINT AS head FROM own
), rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(list_slice(b.turns, 1, o.head), []), list_slice(o.turns, o.head + 1, len(o.turns))) AS turns
    FROM heads o LEFT JOIN heads b ON b.conv_id = o.conv_id - o.conv_id % 100
), places AS (
    SELECT conv_id, d, len(turns) = d AS ends, md5(to_json(list_slice(turns, 1, d))::VARCHAR) AS name,
        CASE WHEN d > 0 THEN md5(to_json(list_slice(turns, 1, d - 1))::VARCHAR) END AS parent,
        CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS size
    FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT name, d, any_value(parent) AS parent, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM places GROUP BY name, d
), kids AS (
    SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
    SELECT p.name, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
    FROM nodes n JOIN places p ON p.conv_id = n.conv_id AND p.d <= n.d LEFT JOIN kids k ON k.parent = n.name
    GROUP BY p.name
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
    s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.name = n.name LEFT JOIN nodes u ON u.name = n.parent LEFT JOIN kids k ON k.parent = n.name
"""
