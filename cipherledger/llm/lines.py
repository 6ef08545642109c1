"""Line dedup over overlapping windows of three lines, in DataFrame operations only.

Each window of consecutive lines has a hash of 128 bits. Of all places of a window the first (by doc_id, then line)
stays; every later one covers its lines, and the covered lines of a document, merged, are removed. Since a removed line
stands in an earlier place, every line of the corpus is kept at least once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.llm.store import written

WINDOW = 3


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def places(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, line, high, low``: every window of every text, with its first line's number and its hash."""
    lines = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"),
        # two hashes of each line that don't depend on each other
        F.transform(split_lines(F.col("text")), lambda x: F.xxhash64(x)).alias("high"),
        F.transform(split_lines(F.col("text")), lambda x: F.xxhash64(F.lit(1), x)).alias("low"),
    ).where(F.size("high") >= WINDOW)

    def window(i: Column) -> Column:
        high, low = ([F.get(name, i + k) for k in range(WINDOW)] for name in ("high", "low"))
        return F.struct(i.alias("line"), F.xxhash64(*high).alias("high"), F.xxhash64(*low).alias("low"))

    starts = F.sequence(F.lit(0), F.size("high") - WINDOW)
    return lines.select("doc_id", "text_hash", F.explode(F.transform(starts, window)).alias("at")).select(
        "doc_id", "text_hash", "at.*"
    )


def later_places(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, starts``: where windows begin that stand in an earlier place too."""
    place = F.struct("doc_id", "text_hash", "line")
    # read back, both sides of the join are dealt anew, so that a window of very many places can be split
    repeated = written(
        places(docs).groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("high", "low", "first")
    )
    return (
        places(docs).join(repeated, ["high", "low"]).where(~F.col("first").eqNullSafe(place))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("starts"))
    )


def dedup(docs: DataFrame) -> DataFrame:
    """Documents without the lines of later places, with ``n_lines`` before and ``n_removed``.

    All rows and columns stay (own ``n_lines`` and ``n_removed`` are replaced). Lines end at a line feed; texts of fewer
    than three lines, and null ones (no lines), stay as they are. Places are ordered by doc_id, nulls first, then by a
    hash of the text where ids repeat; rows equal in both are one document and all keep the same lines.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*own)
    covered = later_places(docs.select("doc_id", "text")).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"),
        F.flatten(F.transform("starts", lambda s: F.array(*[s + k for k in range(WINDOW)]))).alias("_covered"),
    )
    lines = split_lines(F.col("text"))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_covered"))
    joined = docs.join(
        covered, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash")), "left"
    )
    # an array of one, so that the text is split once and not for every line
    bound = F.array(F.struct(lines.alias("lines"), kept.alias("kept")))
    rest = F.transform(bound, lambda b: F.array_join(F.transform(b["kept"], lambda i: F.get(b["lines"], i)), "\n"))
    text = F.when(F.col("_covered").isNull(), F.col("text")).otherwise(F.get(rest, F.lit(0)))
    n_removed = F.when(F.col("_covered").isNull(), 0).otherwise(F.size(lines) - F.size(kept))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in own],
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).alias("n_lines"), n_removed.alias("n_removed"),
    )
