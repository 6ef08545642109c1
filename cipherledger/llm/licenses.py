"""License scans: ordered signature rules behind a keyword prefilter.

A rule's pattern runs only over texts that hold one of its keywords. Detections are places in words; they are taken in order of
priority, longer ones first, and one that lies within a kept one is suppressed. Base phrases are never suppressed.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.llm import bpe
from cipherledger.llm.license_rules import Rule, rules

#: A word, once A-Z are lower case; on UTF-8 bytes the class is the same as on characters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
IN_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
#: The first sieve, over raw text: every rule's match holds one of these within a word.
SIEVE = (
    b"licen", b"spdx", b"cc", b"bsd", b"commons", b"mozilla", b"eclipse", b"joinup", b"wtfpl", b"consortium", b"scripts",
    b"permission", b"redistribut", b"warranty", b"unencumbered", b"hereby", b"domain", b"reserved", b"confidential",
    b"released", b"distributed", b"published", b"available", b"provided", b"offered", b"shared", b"covered",
    b"software", b"copyright", b"gpl", b"apache", b"endorse", b"advertising", b"altered", b"executable", b"verbatim", b"royalty",
    b"waived", b"remotely", b"classpath", b"bison", b"perl", b"ruby", b"mulan", b"unicode", b"beer", b"reproduction", b"forbidden",
    b"prohibited", b"evaluation", b"internal", b"commercial",
)
DETECTION = pa.struct([
    ("rule", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64()),
])


@functools.lru_cache(maxsize=1)
def by_gate() -> dict[bytes, list[tuple[int, Rule]]]:
    """Numbered rules by keyword, so one search decides for all that share it."""
    table: dict[bytes, list[tuple[int, Rule]]] = {}
    for number, rule in enumerate(rules()):
        for gate in rule.gates:
            table.setdefault(gate, []).append((number, rule))
    return table


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that no kept one of the same or a higher rank contains. Equal places keep the first rule's.

    What contains a detection begins before it, or with it and ends no earlier; so in that order the farthest end of each
    priority so far tells all. What is itself suppressed may suppress: the one that contains it contains both.
    """
    kept: list[tuple[int, int, Rule]] = []
    reached: dict[int, int] = {}
    for start, end, rule in sorted(found, key=lambda d: (d[0], -d[1], -d[2].priority, d[2].name)):
        inside = any(far >= end for priority, far in reached.items() if priority >= rule.priority)
        if rule.name.startswith("base:") or not inside:
            kept.append((start, end, rule))
        reached[rule.priority] = max(end, reached.get(rule.priority, -1))
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].name))


def detect(lower: bytes) -> list[tuple[int, int, Rule]]:
    """Kept detections of a text in lower case: first and last word (from 0), and the rule."""
    words = WORD.findall(lower)
    line = b" ".join(words)
    starts: np.ndarray | None = None
    found = []
    opened = {number: rule for gate, own in by_gate().items() if gate in line for number, rule in own}
    for rule in opened.values():
        for m in rule.pattern.finditer(line):
            if starts is None:
                starts = np.cumsum([0, *(len(w) + 1 for w in words[:-1])]).tolist()
            found.append((bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1) - 1, rule))
    return resolve(found)


def count_words(lower: list[bytes]) -> np.ndarray:
    """Number of words of each text."""
    inside = IN_WORD[np.frombuffer(b"\n".join([b"", *lower]), dtype=np.uint8)]
    begins = np.append(0, np.cumsum(inside[1:] & ~inside[:-1]))
    stops = np.cumsum([len(t) + 1 for t in lower])
    return np.diff(begins[stops - 1], prepend=0) if lower else np.zeros(0, dtype=np.int64)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, detections``: licence signatures of every whole text, each with rule, label, first and last
    word (from 0) and weight.

    Null and empty texts have no words. Each row is judged by itself, so repeated rows and null ids stay as they are;
    other columns are left out.
    """
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.small(source):
            texts = batch.column(1).to_pylist()
            for a, b in bpe.runs(texts):
                lower = [t.encode("utf-8").lower() for t in texts[a:b]]
                found = [detect(t) if any(s in t for s in SIEVE) else [] for t in lower]
                shown = [
                    [{"rule": r.name, "label": r.label, "start": x, "end": y, "weight": r.weight} for x, y, r in text]
                    for text in found
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(count_words(lower), pa.int64()), pa.array(shown, pa.list_(DETECTION))],
                    ["doc_id", "n_words", "detections"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    detection = "struct<rule:string,label:string,start:long,end:long,weight:double>"
    return rows.mapInArrow(batches, f"doc_id long, n_words long, detections array<{detection}>")
