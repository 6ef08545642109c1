"""Sets of word shingles as 64-bit numbers, by the batch in numpy."""

from __future__ import annotations

from functools import reduce

import numpy as np

#: Bytes between words.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
P = np.uint64(0x9E3779B97F4A7C15 | 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of every text, and how many words each text has."""
    if not texts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    # a polynomial over the bytes of the batch; a word's part of it, divided by its place, is the word's own
    inverse = np.uint64(pow(int(P), -1, 2**64))
    upto = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(P, len(data)))
    part = upto[ends - 1] - upto[starts - 1]
    hashes = mixed(part * powers(inverse, len(data))[starts])
    stops = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, stops), prepend=0)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct n-word shingles of each text, sorted; with fewer words, the whole sequence as one; none without words."""
    words, counts = word_hashes(texts)
    if not len(words):
        return [words] * len(texts)
    multipliers = [np.uint64(m) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        scaled = [mixed(p + np.uint64(k)) * multipliers[k % 5] for k, p in enumerate(parts)]
        return mixed(reduce(np.add, scaled))

    padded = np.append(words, np.zeros(n, dtype=np.uint64))
    shingles = joined([padded[k : k + len(words)] for k in range(n)])
    found, begin = [], 0
    for count in counts.tolist():
        if count >= n:
            found.append(np.unique(shingles[begin : begin + count - n + 1]))
        elif count:
            found.append(joined([words[begin + k : begin + k + 1] for k in range(count)]))
        else:
            found.append(words[:0])
        begin += count
    return found


def parities(shingles: np.ndarray) -> list[int]:
    """Parity of the shingles over at least as many cells, a power of two from 512 on, as longs.

    Two sets differ in at least as many elements as in cells. Half as many cells are the two halves' exclusive or.
    """
    cells = max(512, 1 << (max(len(shingles), 1) - 1).bit_length())
    odd = np.bincount((shingles % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
