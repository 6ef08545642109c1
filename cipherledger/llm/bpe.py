"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring base symbols (a byte, or the last byte of a word with its end mark) that stand side by side in no
vocabulary token can never be merged over, so every such pair is a certain cut. Words fall into fragments there, each
distinct fragment is merged once (all fragments of a batch at a time, in numpy), and a text's ids are the concatenation
of its fragments' ids.

The vocabulary file is a tokenizers JSON of the word kind: NFC, white space squeezed, lower case, words split by class,
bytes as symbols, ``</w>`` at a word's end. Its path must be readable on every executor (an installed package's file).
"""

from __future__ import annotations

import ctypes
import functools
import gc
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that a worker's chunks, words and fragments may take, each: common ones stay at hand, memory doesn't grow with
#: the input, however long they are.
CACHE_BYTES = 96_000_000
#: What an entry costs besides the characters of its key and the bytes of its value.
ENTRY_BYTES = 180
#: Rows of an Arrow batch that are taken out at once.
SLICE_ROWS = 256
#: Texts are handled in runs of about this many characters, so memory doesn't follow the Arrow batch.
CHUNK_CHARS = 500_000
#: Bytes of text that are encoded at once: the more, the less often a word is looked for.
RUN_BYTES = 2_000_000
END = 256
NO_RANK = np.int32(2**31 - 1)
WHITE = r"\x09-\x0D\x20\x85\xA0  -     　"


class Kept:
    """A map of bounded size: what was not asked for while half of it filled up goes."""

    def __init__(self, always: dict | None = None):
        self.always = always or {}
        self.most: int | None = None  # CACHE_BYTES
        self.clear()

    def clear(self) -> None:
        self.new, self.old, self.size = dict(self.always), {}, 0

    def missing(self, wanted: set) -> set:
        """What of ``wanted`` has to be added; all else is in ``new`` from here on, until the next call."""
        if self.size > (self.most or CACHE_BYTES) // 2:
            self.new, self.old, self.size = dict(self.always), self.new, 0
        left = wanted.difference(self.new)
        # a set's own intersection would walk through all that is kept
        back = list(filter(self.old.__contains__, left))
        if back:
            self.add(dict(zip(back, map(self.old.__getitem__, back), strict=True)))
        return left.difference(back)

    def add(self, found: dict) -> None:
        self.new.update(found)
        self.size += ENTRY_BYTES * len(found) + sum(map(len, found)) + sum(map(len, found.values()))


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {}, 256
    for byte in range(256):
        if byte in plain:
            table[byte] = chr(byte)
        else:
            table[byte], spare = chr(spare), spare + 1
    return [table[byte] for byte in range(256)]


class Vocabulary:
    """Merges, certain cuts and token strings of one vocabulary file, with the worker's word cache."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, number in [*vocab.items(), *self.special.items()]:
            self.tokens[number] = token
        chars = byte_characters()
        symbols = [*chars, *(c + end for c in chars)]
        self.base = np.array([vocab[s] for s in symbols], dtype=np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * 65536 + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.inside = self._pairs_inside(vocab, chars, end)
        self.known, self.words, self.fragments = Kept(self.special_ids()), Kept(), Kept()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.controls = regex.compile(r"[\x1c-\x1f]")
        self.find_chunks = regex.compile(f"[^{WHITE}]+").findall
        self.find_words_and_breaks = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+|\n"
        ).findall

    @staticmethod
    def _pairs_inside(vocab: dict[str, int], chars: list[str], end: str) -> np.ndarray:
        """Which base symbols stand side by side inside some token."""
        byte_of = {c: i for i, c in enumerate(chars)}
        inside = np.zeros((512, 512), dtype=bool)
        for token in vocab:
            stem = token.removesuffix(end)
            line = [byte_of[c] for c in stem]
            if stem != token:
                line[-1] += END
            inside[line[:-1], line[1:]] = True
        return inside

    # ---- text to words

    def normal(self, text: str) -> str:
        """The text as words are cut from it; white space stays as it is, since no word holds any."""
        if not text.isascii():
            # a capital sigma at a word's end has a lower case of its own in Python only
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def chunks(self, text: str) -> list[str | tuple[str]]:
        """What stands between white space, and special tokens (each in a tuple, as a chunk may read the same), in order."""
        if "<|" in text:
            parts = self.split_special.split(text)
            return [c for p in parts for c in ([(p,)] if p in self.special else self.between_white(self.normal(p)))]
        return self.between_white(self.normal(text))

    def between_white(self, text: str) -> list[str]:
        # str.split() also cuts at four control characters, which belong to words
        return self.find_chunks(text) if self.controls.search(text) else text.split()

    # ---- words to ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.chunks(t) for t in texts]
        missing = self.known.missing(set().union(*cut))
        if missing:
            self.known.add(self._of_chunks(list(missing)))
        find = self.known.new.__getitem__
        return [b"".join(map(find, text)) for text in cut]

    def special_ids(self) -> dict[str | tuple[str], bytes]:
        return {(token,): number.to_bytes(4, "little") for token, number in self.special.items()}

    def _of_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of each chunk, put together from its words'; a chunk of ASCII letters alone is one word."""
        single = [c for c in chunks if c.isalpha() and c.isascii()]
        mixed = list(set(chunks).difference(single))
        words = self.find_words_and_breaks("\n".join(mixed) + "\n")
        distinct = set(words)
        distinct.discard("\n")
        distinct.update(single)
        missing = self.words.missing(distinct)
        if missing:
            self.words.add(self._of_words(list(missing)))
        find, begin = self.words.new.__getitem__, 0
        out = dict(zip(single, map(find, single), strict=True))
        for chunk in mixed:
            end = words.index("\n", begin)
            out[chunk] = find(words[begin]) if end == begin + 1 else b"".join(map(find, words[begin:end]))
            begin = end + 1
        return out

    def _of_words(self, words: list[str]) -> dict[str, bytes]:
        """Cut words at certain boundaries, merge the distinct fragments, put the words together."""
        raw = [w.encode("utf-8") for w in words]
        symbols = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint16)
        last = np.cumsum([len(r) for r in raw]) - 1
        symbols[last] += END
        cut = ~self.inside[symbols[:-1], symbols[1:]]
        cut[last[:-1]] = True
        stops = np.append(np.flatnonzero(cut) + 1, len(symbols))
        upto = (np.searchsorted(stops, last, side="right") + 1).tolist()
        packed, stops = symbols.tobytes(), (2 * stops).tolist()
        fragments = [packed[a:b] for a, b in zip([0, *stops], stops)]
        missing = self.fragments.missing(set(fragments))
        if missing:
            self.fragments.add(self._merge(missing))
        ids = list(map(self.fragments.new.__getitem__, fragments))
        return {
            word: ids[begin] if end == begin + 1 else b"".join(ids[begin:end])
            for word, begin, end in zip(words, [0, *upto], upto)
        }

    def _merge(self, fragments: set[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        by_length: dict[int, list[bytes]] = {}
        for f in fragments:
            by_length.setdefault(len(f) // 2, []).append(f)
        for length, group in by_length.items():
            if length > 48:
                for f in group:
                    out[f] = self._merge_long(self.base[np.frombuffer(f, dtype=np.uint16)].tolist())
                continue
            table = self.base[np.frombuffer(b"".join(group), dtype=np.uint16)].reshape(len(group), length)
            for at in range(0, len(group), 50_000):
                some = table[at : at + 50_000]
                flat, counts = self._merge_equal(some)
                data, begin = flat.astype("<u4").tobytes(), 0
                for f, n in zip(group[at : at + 50_000], counts.tolist(), strict=True):
                    out[f] = data[4 * begin : 4 * (begin + n)]
                    begin += n
        return out

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or NO_RANK."""
        key = left.astype(np.int64) * 65536 + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def _merge_equal(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of equal length side by side: every turn does the best leftmost merge of each row."""
        rows, length = table.shape
        # two columns of no symbol: what follows the last symbol, and what precedes the first
        ids = np.full((rows, length + 2), -1, dtype=np.int32)
        ids[:, :length] = table
        ranks = np.full((rows, length + 2), NO_RANK, dtype=np.int32)
        if length > 1:
            ranks[:, : length - 1] = self.rank(table[:, :-1], table[:, 1:])
        after = np.broadcast_to(np.arange(1, length + 3, dtype=np.int16), (rows, length + 2)).copy()
        before = np.broadcast_to(np.arange(-1, length + 1, dtype=np.int16), (rows, length + 2)).copy()
        before[:, 0] = length + 1
        live = np.arange(rows)
        while len(live):
            left = ranks[live, :length].argmin(axis=1)
            best = ranks[live, left]
            going = best < NO_RANK
            live, left, best = live[going], left[going], best[going]
            right = after[live, left]
            then, prior = after[live, right], before[live, left]
            new = self.made[best]
            ids[live, left], ids[live, right] = new, -1
            ranks[live, right] = NO_RANK
            after[live, left] = then
            before[live, then] = left
            ranks[live, left] = self.rank(new, ids[live, then])
            ranks[live, prior] = self.rank(ids[live, prior], new)
        kept = ids[:, :length] >= 0
        return ids[:, :length][kept], kept.sum(axis=1)

    def _merge_long(self, ids: list[int]) -> bytes:
        """The same for one long fragment, with a heap of merges."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks = self.rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < NO_RANK]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            r = int(self.rank(np.array([ids[i]]), np.array([ids[j]]))[0])
            if r < NO_RANK:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def bound(self, cache_bytes: int | None) -> None:
        """What each cache may take from here on (None: CACHE_BYTES)."""
        for kept in (self.known, self.words, self.fragments):
            kept.most = cache_bytes

    def rest(self) -> None:
        """At a task's end: the worker process goes on, maybe to other work, which bounded caches leave the room to."""
        if self.known.most is not None:
            self.forget()

    def forget(self) -> None:
        """Empty the caches."""
        for kept in (self.known, self.words, self.fragments):
            kept.clear()

    # ---- ids to text

    def decode(self, ids: bytes) -> str:
        """Token strings with a blank between them: the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """One vocabulary per worker process."""
    return Vocabulary(path)


def runs(texts: list[str]):
    """Slices of texts of about CHUNK_CHARS characters."""
    begin = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= CHUNK_CHARS:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in small slices: what is made of its texts never fills memory as the whole batch would."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(at, SLICE_ROWS)


def by_bytes(batch: pa.RecordBatch, run_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch of (key, text) in slices of about ``run_bytes`` of text (RUN_BYTES), or one longer text."""
    sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes, dtype=np.int64) // (run_bytes or RUN_BYTES)
    stops = [*(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
    for begin, stop in zip([0, *stops], stops):
        if stop > begin:
            yield batch.slice(begin, stop - begin)


def give_back() -> None:
    """Freed memory goes back to the system: a worker process lives on, and so does what its allocators hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def small(
    batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary | None = None, run_bytes: int | None = None
) -> Iterator[pa.RecordBatch]:
    """A task's batches in small slices, by bytes of text where a vocabulary encodes them.

    At the task's end freed memory is given back, and the vocabulary's caches if they are bounded below CACHE_BYTES; else
    what one task has worked out serves the next.
    """
    for batch in batches:
        yield from by_bytes(batch, run_bytes) if vocabulary else slices(batch)
    if vocabulary:
        vocabulary.rest()
    give_back()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: ids of every whole text, packed as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids. Rows are handled one by one, so repeated rows and null ids stay as they are;
    other columns are left out.
    """
    def batches(source):
        vocabulary = load(path)
        vocabulary.bound(None)
        for some in small(source, vocabulary):
            ids = vocabulary.encode(some.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded``: the text that the vocabulary writes for packed ids (null ids: empty)."""
    def batches(source):
        vocabulary = load(path)
        for batch in source:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [vocabulary.decode(x or b"") for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(batches, "doc_id long, ids binary, decoded string")
