"""Language identification by error-correcting output codes.

Every language has a codeword. One binary classifier per bit weighs byte n-grams by the log odds of the languages whose
bit is 1 against the others, each language counting alike. Decoding takes the codeword of least logistic loss, each bit
weighted by how well it did on the training rows; a text is ambiguous if the next codeword is about as near.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.llm import bpe

#: Unless all are to teach, the model is fitted on one share of the labelled rows, chosen by a hash: this many to twice as
#: many (all, if fewer).
TRAIN_DOCS = 20_000
#: Of each language at least this many rows are used, and all, if it has fewer than twice as many.
TRAIN_DOCS_EACH = 1_000
BUCKETS = 8192
#: A text is ambiguous if the chosen language has less than this share against the next.
CLEAR = 0.6
UNKNOWN = "und"
HAS_LETTER = regex.compile(r"\p{L}")
#: What an n-gram needs.
TEACHES = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
#: ASCII that is no letter counts as a blank.
BYTES = np.array([b if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint32)
TEXTS_AT_ONCE = 64
#: Bytes whose n-grams are counted at once: what is made of a text takes no more room the longer it is.
BYTES_AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit, -1 or 1
    weights: np.ndarray  # bucket x bit
    trust: np.ndarray  # of each bit


def codewords(n: int) -> np.ndarray:
    """Codewords of n languages: all distinct splits for up to 5, else the seeded draw of greatest distance."""
    if n <= 5:
        columns = [[1 if i == 0 or not k >> (i - 1) & 1 else -1 for i in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(columns, dtype=np.float64).reshape(-1, n).T
    rng, best, farthest = np.random.default_rng(5), None, -1
    bits = 8 + 4 * math.ceil(math.log2(n))
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        code[rng.integers(n), np.abs(code.sum(axis=0)) == n] *= -1
        apart = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if apart.min() > farthest:
            best, farthest = code, apart.min()
    return best


def profiles(texts: list[str]) -> np.ndarray:
    """Counts of hashed byte pairs and triples of each whole text, text x bucket."""
    raw = [b" " + t.lower().encode("utf-8") + b"  " for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    bounds = np.cumsum([0, *map(len, raw)])
    shift = np.uint32(32 - int(math.log2(BUCKETS)))
    out = np.zeros(len(raw) * BUCKETS, dtype=np.int64)
    for begin in range(0, len(data) - 2, BYTES_AT_ONCE):
        at = BYTES[data[begin : begin + BYTES_AT_ONCE + 2]]
        owner = np.repeat(np.arange(len(raw)) * BUCKETS, np.diff(np.clip(bounds, begin, begin + len(at) - 2)))
        pair = at[:-1] << 8 | at[1:]
        triple = pair[:-1] << 8 | at[2:]
        pair = pair[:-1]
        inner = triple & 0xFFFF != 0x2020
        last = bounds[1:] - 1 - begin
        inner[last[(last >= 0) & (last < len(inner))]] = False  # would reach into the next text
        for gram, keep, salt in ((pair, pair != 0x2020, np.uint32(0x9E3779B9)), (triple, inner, np.uint32(0))):
            cells = owner[keep] + (gram[keep] * np.uint32(2654435761) + salt >> shift)
            out += np.bincount(cells, minlength=len(out))
    return out.reshape(len(raw), BUCKETS)


def in_runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of few texts of bounded length."""
    for a, b in bpe.runs(texts):
        for at in range(a, b, TEXTS_AT_ONCE):
            yield at, min(b, at + TEXTS_AT_ONCE)


def margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """What each bit's classifier says of each text: mean log odds, surer the longer the text."""
    out = np.zeros((len(texts), weights.shape[1]))
    for a, b in in_runs(texts):
        counts = profiles(texts[a:b]).astype(np.float32)
        out[a:b] = counts @ weights / np.sqrt(np.maximum(counts.sum(axis=1), 1))[:, None]
    return out


def _sampled(known: DataFrame) -> DataFrame:
    """At most about 2 x TRAIN_DOCS rows and 2 x TRAIN_DOCS_EACH of each language, and some of every language that has any."""
    known = known.select("text", "lang", F.xxhash64("doc_id", "text").alias("hash"))
    held = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("hash").alias("least")).collect()
    common = max(1, sum(r["n"] for r in held) // TRAIN_DOCS)
    shares = [(r["lang"], max(1, min(common, r["n"] // TRAIN_DOCS_EACH)), r["least"]) for r in held]
    # a language's sample is dealt from its least hash, so it is never empty
    dealt = known.sparkSession.createDataFrame([(lang, n, least % n) for lang, n, least in shares], "lang string, share long, rest long")
    return known.join(F.broadcast(dealt), "lang").where(F.pmod("hash", "share") == F.col("rest")).select("text", "lang")


def train(labelled: DataFrame, whole: bool = False) -> Model:
    """A model from rows ``doc_id, text, lang``; rows without a letter or language teach nothing.

    All other rows teach if ``whole``, else a sample of them (``TRAIN_DOCS``). What comes together on the driver are
    counts by language and bucket.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(TEACHES))
    sample = known.select("text", "lang") if whole else _sampled(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in bpe.small(batches):
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
            for a, b in in_runs(texts):
                counts = profiles(texts[a:b])
                for lang in set(langs[a:b]):
                    seen[lang] = seen.get(lang, 0) + counts[langs[a:b] == lang].sum(axis=0)
        for lang, counts in seen.items():
            cells = np.flatnonzero(counts)
            columns = [pa.array([lang] * len(cells), pa.string()), pa.array(cells), pa.array(counts[cells])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.full((len(languages), BUCKETS), 0.5)
    for lang, bucket, n in rows:
        counts[place[lang], bucket] += n
    code = codewords(len(languages)) if languages else np.zeros((0, 0))
    likely = counts / counts.sum(axis=1, keepdims=True)
    ones, zeros = (code > 0).astype(float), (code < 0).astype(float)
    odds = np.log(ones.T @ likely / np.maximum(ones.sum(axis=0), 1)[:, None]) - np.log(
        zeros.T @ likely / np.maximum(zeros.sum(axis=0), 1)[:, None]
    ) if code.size else np.zeros((0, BUCKETS))
    weights = odds.T.astype(np.float32)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.small(batches):
            # a language is not learned if none of its texts has an n-gram
            rows = [(t, place[x]) for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if x in place]
            said = margins([t for t, _ in rows], weights)
            right = (said * code[[k for _, k in rows]] > 0).sum(axis=0)
            bits = np.arange(code.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(bits), pa.array(right), pa.array(np.full(len(bits), len(rows)))], ["bit", "right", "n"]
            )

    trust = np.ones(code.shape[1])
    if code.size:
        for bit, right, n in sample.mapInArrow(test, "bit long, right long, n long").groupBy("bit").agg(F.sum("right"), F.sum("n")).collect():
            share_right = min(max((right + 1) / (n + 2), 0.51), 0.999)
            trust[bit] = math.log(share_right / (1 - share_right))
    return Model(languages, code, weights, trust / trust.sum() if trust.size else trust)


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is ambiguous, for each text."""
    held = [t or "" for t in texts]
    lettered = np.array([bool(HAS_LETTER.search(t)) for t in held], dtype=bool)
    if not model.languages or not held:
        return [UNKNOWN] * len(held), np.zeros(len(held)), ~lettered  # nothing learned: only texts without letters are odd
    said = margins(held, model.weights)
    bits = max(1, model.code.shape[1])
    loss = np.stack([(np.logaddexp(0, -said * word) * model.trust).sum(axis=1) for word in model.code], axis=1) * bits
    order = np.argsort(loss, axis=1, kind="stable")
    near = np.take_along_axis(loss, order, axis=1)
    share = np.exp(near[:, :1] - near)
    score = 1 / share.sum(axis=1)
    rival = share[:, 1] if near.shape[1] > 1 else np.zeros(len(held))
    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(order[:, 0].tolist(), lettered.tolist(), strict=True)]
    return names, np.where(lettered, score, 0.0), ~lettered | (1 / (1 + rival) < CLEAR)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` of every whole text; ``und`` (score 0, ambiguous) without a letter or text.

    Only the text decides. Rows are judged one by one, so repeated rows and null ids stay; other columns are left out.
    """
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.small(source):
            names, score, unsure = predict(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(batches, "doc_id long, lang_pred string, score double, ambiguous boolean")


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is clear, with all their columns."""
    at = docs.columns.index("text")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.small(source):
            unsure = predict(batch.column(at).to_pylist(), model)[2]
            yield batch.filter(pa.array(~unsure))

    return docs.mapInArrow(batches, docs.schema)
