"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

The last token of a word's encoding is decided by its prefixes alone: of all tokens that end at a position, exactly one
can follow the last token of what stands before it, so one pass over a word gives the number of tokens of each of its
prefixes. Two tokens can stand side by side if no merge reaches over their border before both are whole. A text's table
is put together from those of its distinct words, as white space and word classes bound every merge.

A prefix ends after a code point of the text in NFC (special tokens apart, which are found first). The table holds one
signed byte a prefix, the change of the count; it answers how many tokens a prefix has and which prefix fits a budget,
without another look at the text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cipherledger.llm import bpe

#: Bytes that a worker's tables of words, of chunks and of token pairs may take, each; words and chunks that were not met
#: for half of them go when more come. Words stay from task to task, chunks go with the task.
CACHE_BYTES = 96_000_000
#: What an entry of the pairs costs.
ENTRY_BYTES = 220
#: A change of the count beyond this is written in four bytes, as are all others of that text.
WIDEST = 127
CONTRACTION = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d").fullmatch
NO_LIMIT = 2**40
#: White space besides the blank, in ASCII and in all.
ASCII_WHITE = "\t\n\v\f\r"
ALL_WHITE = [c for c in map(chr, range(0x10000)) if c != " " and regex.match(f"[{bpe.WHITE}]", c)]


class PrefixCounter:
    """Trie of the tokens that encode as themselves, with which token can follow which."""

    def __init__(self, path: str):
        self.vocabulary = bpe.Vocabulary(path)
        own = self.vocabulary
        size = len(own.tokens)
        #: rank of the merge that makes a token (symbols: -1) and its two parts
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merges = dict(zip(own.keys.tolist(), own.ranks.tolist(), strict=True))
        for key, rank in sorted(self.merges.items(), key=lambda merge: -merge[1]):  # of merges to one string, the first counts
            made = int(own.made[rank])
            self.born[made], self.left[made], self.right[made] = rank, key >> 16, key & 65535
        by_rank = sorted((t for t in range(size) if self.born[t] >= 0), key=self.born.__getitem__)
        whole = [t for t in by_rank if self.side_by_side(self.left[t], self.right[t], self.born[t])]
        alone = [*own.base.tolist(), *whole]
        self.inner, self.ending = self._tries(alone)
        self.pairs: dict[int, bool] = {}
        self.words, self.chunks = bpe.Kept(), bpe.Kept({"": b""})
        self.words.most = self.chunks.most = CACHE_BYTES
        self.forget()
        self.last_chunk = regex.compile(rf"[^{bpe.WHITE}]*\Z")

    def side_by_side(self, left: int, right: int, limit: int = NO_LIMIT) -> bool:
        """Whether two tokens stay apart when their strings are joined.

        Both are taken back merge by merge, the later one first; a merge of the two symbols at the border counts only if
        it comes before what was taken back (of equal merges, the left one comes first).
        """
        born, merge = self.born, self.merges.get
        while True:
            across = merge(left << 16 | right)
            if across is not None and across < limit:
                return False
            of_left, of_right = born[left], born[right]
            if of_left > of_right:
                left, limit = self.right[left], of_left
            elif of_right >= 0:
                right, limit = self.left[right], of_right + 1
            else:
                return True

    def _tries(self, tokens: list[int]) -> tuple[dict, dict]:
        """Tokens from their last symbol backwards, without and with an end mark: symbol -> (what may precede, token)."""
        byte_of = {c: i for i, c in enumerate(bpe.byte_characters())}
        strings, inner, ending = self.vocabulary.tokens, {}, {}
        marked = set(self.vocabulary.base[bpe.END :].tolist())
        for token in tokens:
            marks = token in marked or self.right[token] in marked
            if marks:
                marked.add(token)
            line = [byte_of[c] for c in (strings[token].removesuffix("</w>") if marks else strings[token])]
            node, symbol = ending if marks else inner, line.pop()
            for before in reversed(line):
                node, symbol = node.setdefault(symbol, ({}, -1))[0], before
            node[symbol] = (node.get(symbol, ({}, -1))[0], token)
        return inner, ending

    def may_follow(self, pair: int) -> bool:
        """The same of a pair (left << 16 | right), remembered."""
        if len(self.pairs) * ENTRY_BYTES > CACHE_BYTES:
            self.pairs.clear()
        apart = self.pairs[pair] = self.side_by_side(pair >> 16, pair & 65535)
        return apart

    def counts_of_words(self, words: list[str]) -> Iterator[list[int]]:
        """For each of some sorted words the tokens of its prefixes, by code points.

        Of the tokens that end a prefix, shortest first, the one that can follow what stands before it is its last. What a
        word shares with the one before it is not worked out again.
        """
        known, whole, marked = self.pairs, self.inner, self.ending
        last, inner, ended, previous = [0], [0], [0], b""
        for word in words:
            data = word.encode("utf-8")
            shared, n = 0, len(data)
            for a, b in zip(data, previous):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], inner[shared + 1 :], ended[shared + 1 :]
            for at in range(shared + 1, n + 1):
                trie, begin = whole, at
                while True:
                    begin -= 1
                    trie, token = trie[data[begin]]
                    if token >= 0:
                        if not begin:
                            break
                        pair = last[begin] << 16 | token
                        if known[pair] if pair in known else self.may_follow(pair):
                            break
                last.append(token)
                inner.append(inner[begin] + 1)
                trie, begin = marked, at
                while True:
                    begin -= 1
                    trie, token = trie[data[begin]]
                    if token >= 0:
                        if not begin:
                            break
                        pair = last[begin] << 16 | token
                        if known[pair] if pair in known else self.may_follow(pair):
                            break
                ended.append(inner[begin] + 1)
            previous = data
            counts = ended[1:] if n == len(word) else [ended[i] for i in range(1, n + 1) if i == n or data[i] & 0xC0 != 0x80]
            if word[0] == "'" and CONTRACTION(word):  # cut short, it is an apostrophe and letters
                counts[:-1] = range(1, len(counts))
            yield counts

    # ---- words to texts

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Changes of the count within chunks, from those of their distinct words."""
        found = self.vocabulary.find_words_and_breaks("\n".join(chunks) + "\n")
        distinct = set(found)
        distinct.discard("\n")
        new = sorted(self.words.missing(distinct))
        self.words.add({word: self._changes_of(word, counts) for word, counts in zip(new, self.counts_of_words(new), strict=True)})
        words, wide, out, begin = self.words.new, self.wide, {}, 0
        for chunk in chunks:
            end = found.index("\n", begin)
            if wide and not wide.keys().isdisjoint(found[begin:end]):
                self._keep_wide(chunk, np.concatenate([self._widened(w, words) for w in found[begin:end]]))
            out[chunk] = words[found[begin]] if end == begin + 1 else b"".join([words[w] for w in found[begin:end]])
            begin = end + 1
        return out

    def _changes_of(self, word: str, counts: list[int]) -> bytes:
        changes = list(map(int.__sub__, counts, [0, *counts]))
        if max(changes) > WIDEST or min(changes) < -WIDEST:
            self._keep_wide(word, np.array(changes, dtype=np.int32))
            return bytes(len(changes))
        return np.array(changes, dtype=np.int8).tobytes() if min(changes) < 0 else bytes(changes)

    def _keep_wide(self, own: str, changes: np.ndarray) -> None:
        self.wide[own] = changes
        self.of_wide += ENTRY_BYTES + 5 * len(own)

    def _widened(self, own: str, table: dict[str, bytes]) -> np.ndarray:
        return self.wide[own] if own in self.wide else np.frombuffer(table[own], np.int8).astype(np.int32)

    def forget(self) -> None:
        """Start the tables of words and chunks anew."""
        self.words.clear()
        self.wide: dict[str, np.ndarray] = {}
        self.of_wide = 0
        self.forget_chunks()

    def forget_chunks(self) -> None:
        """Give the memory of chunks back; words stay."""
        self.chunks.clear()

    def _changes(self, chunks: list[str]) -> np.ndarray:
        """Changes over chunks (all of them known) and the one blank between any two."""
        table = self.chunks.new
        if self.wide and not self.wide.keys().isdisjoint(chunks):
            blank = np.zeros(1, np.int32)
            return np.concatenate([x for c in chunks for x in (blank, self._widened(c, table))][1:])
        return np.frombuffer(b"\0".join(map(table.__getitem__, chunks)), np.int8)

    def _cut(self, part: str) -> tuple[list[str], str]:
        """What stands between any two white characters of a part without special tokens, as the tokenizer sees it; the part in NFC.

        Two white characters side by side have an empty chunk between them.
        """
        nfc = part if part.isascii() else unicodedata.normalize("NFC", part)
        text = self.vocabulary.normal(nfc)
        for white in ASCII_WHITE if text.isascii() else ALL_WHITE:
            text = text.replace(white, " ")
        return text.split(" "), nfc

    def _of_part(self, pieces: list[str], nfc: str) -> np.ndarray:
        changes = self._changes(pieces)
        if len(changes) != len(nfc):  # a letter whose lower case is two
            sizes = [len(c.lower()) for c in nfc]
            starts = np.cumsum([0, *sizes[:-1]])
            changes = np.add.reduceat(changes.astype(np.int32), starts)
        return changes

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the change of the token count with each prefix, by code points."""
        plans, wanted = [], set()
        for text in texts:
            parts = self.vocabulary.split_special.split(text) if "<|" in text else [text]
            plan = []
            for i in range(0, len(parts), 2):
                pieces, nfc = self._cut(parts[i])
                wanted.update(pieces)
                plan.append((pieces, nfc))
                if i + 1 < len(parts):
                    # cut short, a special token is ordinary text that goes on with what stands before it
                    tail = self.last_chunk.search(nfc).group()
                    ordinary, joined = self._cut(tail + parts[i + 1])
                    wanted.update(ordinary)
                    plan.append((ordinary, joined, len(tail)))
            plans.append(plan)
        if self.of_wide > CACHE_BYTES:
            self.forget()
        missing = self.chunks.missing(wanted)
        if missing:
            self.chunks.add(self._learn(list(missing)))
        return [self._of_plan(plan) for plan in plans]

    def _of_plan(self, plan: list[tuple]) -> np.ndarray:
        if len(plan) == 1:
            return self._of_part(*plan[0])
        out = []
        for step in plan:
            changes = self._of_part(step[0], step[1]).astype(np.int32)
            if len(step) == 3:
                # counts of the chunk that the special token's beginning goes on with, against the chunk's own
                tail = int(out[-1][len(out[-1]) - step[2] :].sum()) if step[2] else 0
                inside = np.cumsum(changes)[step[2] :] - tail
                inside[-1] = 1  # whole, it is one token
                changes = np.diff(inside, prepend=0)
            out.append(changes)
        return np.concatenate(out)


def _packed(changes: np.ndarray) -> bytes:
    """The width of a number in bytes, then the numbers."""
    if changes.dtype != np.int8 and len(changes) and (changes.max() > WIDEST or changes.min() < -WIDEST):
        return b"\4" + changes.astype("<i4").tobytes()
    return b"\1" + changes.astype(np.int8).tobytes()


def unpacked(table: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... code points."""
    changes = np.frombuffer(table, dtype=np.int8 if table[0] == 1 else "<i4", offset=1)
    counts = np.zeros(len(changes) + 1, dtype=np.int64)
    np.cumsum(changes, out=counts[1:])
    return counts


@functools.lru_cache(maxsize=2)
def load(path: str) -> PrefixCounter:
    """One counter per worker process."""
    return PrefixCounter(path)


def count_prefixes(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, prefixes``: the tokens of every whole text, and the packed table of all its prefixes.

    Null and empty texts have no tokens and a table of the empty prefix. Rows are handled one by one: repeated rows and
    null ids stay as they are, an empty table gives none. A very long text takes time and memory in proportion; words of
    any length go through the same program. Other columns are left out.
    """
    def batches(source):
        counter = load(path)
        for batch in source:
            for some in bpe.slices(batch):
                keys, texts = some.column(0), some.column(1).to_pylist()
                for a, b in bpe.runs(texts):
                    tables = counter.tables(texts[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.slice(a, b - a),
                            pa.array([len(t.encode("utf-8")) for t in texts[a:b]], pa.int64()),
                            pa.array([int(t.sum(dtype=np.int64)) for t in tables], pa.int64()),
                            pa.array([_packed(t) for t in tables], pa.binary()),
                        ],
                        ["doc_id", "n_bytes", "n_tokens", "prefixes"],
                    )
        counter.forget_chunks()
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, n_bytes long, n_tokens long, prefixes binary")


def _asked(tables: pd.Series, numbers: pd.Series, answer) -> pd.Series:
    """An answer for each table and number; none without a number or for a negative one."""
    out = [None if pd.isna(n) or n < 0 else int(answer(unpacked(t), int(n))) for t, n in zip(tables, numbers, strict=True)]
    return pd.Series(out, dtype="Int64")


@F.pandas_udf(LongType())
def _at(tables: pd.Series, lengths: pd.Series) -> pd.Series:
    return _asked(tables, lengths, lambda counts, n: counts[min(n, len(counts) - 1)])


@F.pandas_udf(LongType())
def _within(tables: pd.Series, budgets: pd.Series) -> pd.Series:
    return _asked(tables, budgets, lambda counts, n: np.flatnonzero(counts <= n)[-1])


def tokens_at(prefixes: Column, length: Column) -> Column:
    """Tokens of the prefix of ``length`` code points; beyond the text's end those of the whole text.

    Null for a null or negative length.
    """
    return _at(prefixes, length.cast("long"))


def longest_within(prefixes: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens; null for a null or negative budget.

    Counts can fall when a word becomes whole, so a longer prefix may fit where a shorter one does not.
    """
    return _within(prefixes, budget.cast("long"))
