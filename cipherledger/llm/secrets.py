"""Secret scans: fixed shapes, and tokens that look random to two character Markov models.

A first-order Markov model of random strings and one of ordinary identifiers are counted from labelled samples. A token
whose log-likelihood ratio per character favours the random model is a secret, whatever stands around it.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.llm import bpe

ORDER = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: Each holds one of these in lower case.
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HAS_DIGIT, HAS_LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
#: Hex, access and random tokens hold no white space and are at least this long; only such pieces are searched.
LONG_PIECE = re.compile(r"\S{16,}")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Tokens that the models judge: this long, with a digit and a letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Log-likelihood ratio per character above which a token is random, in nats.
THRESHOLD = 2.0
#: Unless they count all, the models count about this many documents, chosen by a hash of doc_id; the built-in samples too.
SAMPLE_DOCS = 20_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Symbols, any other character, and as a state to step from, the start.
N = len(ALPHABET) + 1
CODES = np.full(256, N - 1, dtype=np.int64)
CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
CODES[ord("\n")] = N
WORDS = (
    "user name config value index buffer parse handler request response session client server table column query "
    "default version number account message update create delete build release test module package option filter "
    "result string integer stream thread worker manager service factory context element document image length"
).split()


def steps(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All steps of all tokens as cells of a model's table, and whose they are. Tokens hold no line break."""
    at = CODES[np.frombuffer("\n".join(["", *tokens]).encode("ascii", "replace"), dtype=np.uint8)]
    owner = np.cumsum(at == N) - 1
    inside = at[1:] != N
    return (at[:-1] * N + at[1:])[inside], owner[1:][inside]


# ---- training


def built_in_samples() -> tuple[list[str], list[int]]:
    """Random strings over the usual alphabets, and identifiers put together from words; the same each time."""
    rng = random.Random(11)
    alphabets = [ALPHABET[:62], ALPHABET[:64], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef", ALPHABET[26:62]]
    strings = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 44))) for _ in range(2000)]
    names = []
    for _ in range(2000):
        parts = rng.choices(WORDS, k=rng.randint(2, 4))
        style = rng.randrange(4)
        name = ["_".join(parts), "-".join(parts), "/".join(parts), "".join(w.capitalize() for w in parts)][style]
        names.append(name + rng.choice(["", "", str(rng.randint(1, 2030)), f"_v{rng.randint(1, 20)}"]))
    return strings + names, [1] * len(strings) + [0] * len(names)


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sample, is_secret`` of batches of texts."""
    for batch in bpe.small(batches):
        samples, secret = [], []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text)
            values = [ASSIGN.match(text, a).group(2) if kind == "assign" else text[a:b] for kind, a, b in spans]
            begin, words = 0, []
            for a, b in [*sorted((a, b) for _, a, b in spans), (len(text), len(text))]:
                words += [w for w in text[begin:a].split() if len(w) >= 6 and w.isascii()]
                begin = max(begin, b)
            samples += values + words
            secret += [1] * len(values) + [0] * len(words)
        columns = [pa.array(samples, pa.string()), pa.array(secret, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["sample", "is_secret"])


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"))


def samples_of(docs: DataFrame) -> DataFrame:
    """``sample, is_secret`` from documents: values in fixed shapes against the words around them.

    Words of under 6 characters tell little and are left out.
    """
    return texts_of(docs).mapInArrow(labelled, "sample string, is_secret int")


def tally(tokens: list[str], secret: list[int]) -> np.ndarray:
    """How often each step stands in ordinary samples, then in secret ones."""
    cells, owner = steps([t.replace("\n", " ") for t in tokens])
    return np.bincount(cells + np.array(secret, dtype=np.int64)[owner] * (N + 1) * N, minlength=2 * (N + 1) * N)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cell, n``: the steps of batches of samples."""
    seen = np.zeros(2 * (N + 1) * N, dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            seen += tally(batch.column(0).to_pylist(), batch.column(1).to_pylist())
    cells = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(seen[cells])], ["cell", "n"])


def train(samples: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each step, from rows ``sample, is_secret`` and the built-in samples.

    Rows with a null are left out. Steps are counted where the samples lie; two tables of fixed size come together.
    """
    known = samples.where("sample IS NOT NULL AND is_secret IS NOT NULL")
    return model_of(known.select("sample", F.col("is_secret").cast("int")).mapInArrow(counted, "cell long, n long"))


def model_of(cells: DataFrame) -> np.ndarray:
    """The model from rows ``cell, n`` of counted steps and the built-in samples."""
    rows = cells.groupBy("cell").agg(F.sum("n")).collect()
    counts = tally(*built_in_samples()).astype(float)
    for cell, n in rows:
        counts[cell] += n
    counts = counts.reshape(2, N + 1, N)
    # a state seldom seen leans on its model's symbols overall
    overall = counts.sum(axis=1, keepdims=True) + 1
    overall /= overall.sum(axis=2, keepdims=True)
    likely = np.log((counts + 8 * overall) / (counts.sum(axis=2, keepdims=True) + 8))
    return (likely[1] - likely[0]).ravel()


def train_on(docs: DataFrame, whole: bool = False) -> np.ndarray:
    """A model from all documents if ``whole``, else from about SAMPLE_DOCS (all, if fewer).

    Their samples are counted by the Python worker that cuts them: two steps in Python would take two workers a task, and
    all of them stay for the work that follows.
    """
    if whole:
        chosen = docs
    else:
        share = max(1, docs.count() // SAMPLE_DOCS)
        chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    return model_of(texts_of(chosen).mapInArrow(lambda batches: counted(labelled(batches)), "cell long, n long"))


# ---- scanning


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches in fixed shapes: kind, start, end."""
    found = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    for piece in LONG_PIECE.finditer(text):
        part, at = piece.group(), piece.start()
        if "AKIA" in part:
            found += [("access", at + m.start(), at + m.end()) for m in ACCESS.finditer(part) if len(m.group()) >= 20]
        found += [("hex", at + m.start(), at + m.end()) for m in LONG_HEX.finditer(part)]
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens for the models to judge."""
    found = []
    for piece in LONG_PIECE.finditer(text):
        for m in CANDIDATE.finditer(piece.group()):
            token = m.group()
            if not token.isalpha() and HAS_DIGIT.search(token) and HAS_LETTER.search(token):
                found.append((piece.start() + m.start(), piece.start() + m.end()))
    return found


def apart(tokens: list[tuple[int, int]], spans: list[tuple[str, int, int, float]]) -> list[tuple[int, int]]:
    """Of tokens in order those that overlap no span."""
    upcoming, far, out = iter(sorted(s[1:3] for s in spans)), 0, []
    following = next(upcoming, None)
    for a, b in tokens:
        while following and following[0] < b:
            far = max(far, following[1])
            following = next(upcoming, None)
        if far <= a:
            out.append((a, b))
    return out


def find(texts: list[str], model: np.ndarray, threshold: float = THRESHOLD) -> list[list[tuple[str, int, int, float]]]:
    """Spans of each text by start, then kind: kind, start, end and score (1 for fixed shapes)."""
    spans = [[(*s, 1.0) for s in base_spans(t)] for t in texts]
    asked = [(i, a, b) for i, t in enumerate(texts) for a, b in apart(candidates(t), spans[i])]
    if asked:
        cells, owner = steps([texts[i][a:b] for i, a, b in asked])
        ratio = np.bincount(owner, weights=model[cells]) / np.bincount(owner)
        for (i, a, b), r in zip(asked, ratio.tolist(), strict=True):
            if r > threshold:
                spans[i].append(("random", a, b, 1 / (1 + math.exp(-r * (b - a)))))
    return [sorted(s, key=lambda x: (x[1], ORDER.index(x[0]))) for s in spans]


def scan(docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, spans``: secrets of every whole text (null: empty), each with kind, start, end (code points), score.

    Each row is judged by itself, so repeated rows and null ids stay as they are; other columns are left out.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.small(source):
            found = find(batch.column(1).to_pylist(), model, threshold)
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in text] for text in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def mask(text: str, spans: list[tuple[str, int, int, float]], by: str) -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, begin = [], 0
    for _, a, b, _ in spans:
        if a >= begin:
            out += [text[begin:a], by]
        begin = max(begin, b)
    return "".join([*out, text[begin:]])


def redact(docs: DataFrame, model: np.ndarray, by: str = "[SECRET]") -> DataFrame:
    """Documents with their secrets masked; all rows and columns stay, a null text stays null."""
    at = docs.columns.index("text")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.small(source):
            texts = batch.column(at).to_pylist()
            found = find([t or "" for t in texts], model)
            clean = [mask(t, s, by) if s else t for t, s in zip(texts, found, strict=True)]
            columns = batch.columns
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(batches, docs.schema)
