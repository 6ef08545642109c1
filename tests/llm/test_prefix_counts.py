"""Token counts of prefixes: every prefix against the tokenizers library, odd rows, budgets."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cipherledger.llm import prefix_counts, queries
from tests.llm.test_texts import HARD

PIECES = [
    *"abcdefghijklmnopqrstuvwxyzABC  \n'’.,!?0123é́ñ日本語İΣσ😀<|>endoftx_/\\\x1c\x85̸",
    "<|endoftext|>", "'ll", "'re", "'s", "don't", "the", "ing", "internationalization",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.VOCABULARY)


def of_every_prefix(library, counter, text):
    """The library's counts over the text in NFC, special tokens apart."""
    own = counter.vocabulary
    text = "".join(p if p in own.special else unicodedata.normalize("NFC", p) for p in own.split_special.split(text))
    encoded = library.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)
    return [len(e.ids) for e in encoded]


def test_every_prefix_counts_as_the_library_does(library):
    counter = prefix_counts.load(queries.VOCABULARY)
    dice = random.Random(13)
    texts = HARD + ["".join(dice.choices(PIECES, k=dice.randint(1, 40))) for _ in range(300)]
    for text, table in zip(texts, counter.tables(texts), strict=True):
        assert prefix_counts.unpacked(prefix_counts._packed(table)).tolist() == of_every_prefix(library, counter, text), text


def test_wide_changes_and_full_caches_give_the_same(library, monkeypatch):
    monkeypatch.setattr(prefix_counts, "WIDEST", 0)
    monkeypatch.setattr(prefix_counts, "CACHE_BYTES", 1)
    counter = prefix_counts.PrefixCounter(queries.VOCABULARY)
    for text in HARD:
        packed = prefix_counts._packed(counter.tables([text])[0])
        assert prefix_counts.unpacked(packed).tolist() == of_every_prefix(library, counter, text)


def test_one_long_word_takes_time_in_proportion():
    counter = prefix_counts.load(queries.VOCABULARY)
    blob = "".join(random.Random(1).choices("abcdefgh0123456789+/", k=300_000))
    library = Tokenizer.from_file(queries.VOCABULARY)
    for text in (blob, "y" * 300_000):
        assert counter.tables([text])[0].sum() == len(library.encode(text, add_special_tokens=False).ids)


def test_query_on_odd_rows(spark, odd_docs, no_docs, library):
    rows = prefix_counts.count_prefixes(odd_docs, queries.VOCABULARY).collect()
    texts = odd_docs.collect()
    assert len(rows) == len(texts) and prefix_counts.count_prefixes(no_docs, queries.VOCABULARY).count() == 0
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want


def test_query_by_brute_force(spark, library):
    from tests.llm.conftest import SF

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for row in queries.op13_token_counts(spark, SF).collect():
        n = len(library.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(texts[row.doc_id].encode()), n, n > 2048)


def test_budgets_without_encoding_again(spark, library):
    text = "Pack my box with five dozen liquor jugs, internationalization!"
    docs = spark.createDataFrame([(1, text, 5), (2, text, 0), (3, text, 1000), (4, None, 3), (5, text, None), (6, text, -1)], "doc_id long, text string, n int")
    table = prefix_counts.count_prefixes(docs, queries.VOCABULARY).join(docs.select("doc_id", "n"), "doc_id")
    rows = table.select(
        "doc_id", prefix_counts.tokens_at(F.col("prefixes"), F.col("n")).alias("at"),
        prefix_counts.longest_within(F.col("prefixes"), F.col("n")).alias("within"),
    ).collect()
    got = {r.doc_id: (r["at"], r.within) for r in rows}
    counts = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert got[1] == (counts[5], max(i for i, c in enumerate(counts) if c <= 5))
    assert got[2] == (0, 0) and got[3] == (counts[-1], len(text)) and got[4] == (0, 0) and got[5] == got[6] == (None, None)


def test_common_words_outlast_full_tables_and_white_space_of_any_kind_counts(library, monkeypatch):
    monkeypatch.setattr(prefix_counts, "CACHE_BYTES", 20_000)
    counter = prefix_counts.PrefixCounter(queries.VOCABULARY)
    worked_out, learn = [], counter.counts_of_words
    monkeypatch.setattr(counter, "counts_of_words", lambda words: worked_out.extend(words) or learn(words))
    white = [" ", "  ", "\n", "\t \v", "\x85", "\xa0 ", "  ", "　\r\n", ""]
    for i in range(60):
        text = white[i % 9] + white[i // 9 % 9].join(["common", "words", *(f"rare{'abcdefgh'[i % 8]}{'xyz'[k % 3]}{chr(97 + i % 26)}{chr(97 + k)}" for k in range(20))]) + white[-1 - i % 9]
        assert counter.tables([text])[0].sum() == len(library.encode(text, add_special_tokens=False).ids)
        assert len(counter.tables([text])[0]) == len(text)
    assert worked_out.count("common") < 5
    assert counter.words.size < 60_000
