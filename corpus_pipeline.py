"""A training-data pipeline over documents: language, repeated lines, near duplicates, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.llm import jaccard, languages, lines, packing, secrets
from cipherledger.llm.queries import VOCABULARY, held_out
from cipherledger.llm.store import written

#: Packing comes last, on executors whose heap the earlier stages have filled, so its workers take less than ``op6`` lets
#: them: bytes of each of a worker's three caches, bytes of text encoded at once, rows handed to a worker at once.
CACHE_BYTES, RUN_BYTES, BATCH_ROWS = 16_000_000, 500_000, 512

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_lengths(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the texts now are."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without a letter, or between two languages, go.

    The model is fitted on all documents that are not held out.
    """
    return languages.recognised(docs, languages.train(docs.where(~held_out()), whole=True))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere before; those that held nothing else go."""
    kept = lines.dedup(docs).where((F.col("n_removed") < F.col("n_lines")) | (F.col("n_removed") == 0))
    return _with_lengths(kept.select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles equal by eight tenths, the smallest doc_id.

    Rows that share id and text stay or go together; rows without an id go if they are linked to one that has one.
    """
    groups = jaccard.join(docs, 5, 80).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = groups.select(F.col("doc_id").alias("_stays"))
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_stays")), "left_semi")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; the models are counted over all of them."""
    return _with_lengths(secrets.redact(docs, secrets.train_on(docs, whole=True)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens with their ids and their place in a sequence; every document has at least one."""
    cut = packing.pieces(docs, VOCABULARY, 2048, cache_bytes=CACHE_BYTES, run_bytes=RUN_BYTES)
    return packing.pack(cut, 2048, BATCH_ROWS)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Tokenizing, trained models and the packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through all stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
