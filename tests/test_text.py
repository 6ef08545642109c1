"""Lines, trimming, decoding and globs agree with Python's own."""

import re
import warnings

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from hypothesis.errors import NonInteractiveExampleWarning
from pyspark.sql import functions as F

from cipherledger.fixed import source_rules, text_rules
from cipherledger.functions import globs, patterns, text
from cipherledger.operators.detect_text import detect_secrets, detect_source
from cipherledger.operators.lines import number_lines
from tests.conftest import places

ALPHABET = "ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  é"


def samples(pattern, count=2, one_line=False):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", NonInteractiveExampleWarning)
        strategy = st.from_regex(re.compile(pattern, re.ASCII)).filter(
            lambda sample: re.search(pattern, sample) and not (one_line and len(sample.splitlines()) > 1)
        )
        return [strategy.example() for _ in range(count)]


def test_lines_and_strip_like_python(spark):
    texts = []

    @settings(max_examples=300, database=None, suppress_health_check=list(HealthCheck))
    @given(st.text(ALPHABET, max_size=12))
    def collect(value):
        texts.append(value)

    collect()
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", text.split_lines(F.col("t")).alias("lines"), text.strip(F.col("t")).alias("s"), text.rstrip(F.col("t")).alias("r")
    ).collect()
    for row in rows:
        assert row["lines"] == row["t"].splitlines(), repr(row["t"])
        assert row["s"] == row["t"].strip(), repr(row["t"])
        assert row["r"] == row["t"].rstrip(), repr(row["t"])


def test_context_windows(spark):
    files = spark.createDataFrame([("f", "\n".join("abcde"))], "path string, content string")
    rows = {r["line_number"]: r for r in number_lines(files, 2).collect()}
    assert rows[1]["context_before"] == [] and rows[1]["context_after"] == ["b", "c"]
    assert rows[4]["context_before"] == ["b", "c"] and rows[4]["context_after"] == ["e"]
    assert len(rows) == 5


def test_decoding_drops_malformed_bytes(spark):
    raw = [b"plain", b"a\xffb\xc3", "é�".encode(), b"\xe2\x82"]
    rows = spark.createDataFrame([(bytearray(r),) for r in raw], "c binary").select(text.decode_utf8(F.col("c")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["plain", "ab", "é�", ""]


def test_required_literals_are_in_every_match():
    rules = [r[2] for rows in source_rules.LANGUAGES.values() for r in rows] + [r[1] for r in text_rules.SECRETS]
    checked = 0
    for pattern in rules:
        literals = patterns.required_literals(pattern)
        assert literals, pattern
        for sample in samples(pattern, 1):
            assert any(x in re.search(pattern, sample).group() for x in literals), (pattern, sample)
            checked += 1
    for rows in (text_rules.ANSIBLE, text_rules.DOCKERFILE, text_rules.KUBERNETES, text_rules.CLOUDFORMATION, text_rules.TERRAFORM):
        for _, flags, pattern, *_ in rows:
            literals = patterns.required_literals(pattern, "i" in flags)
            for sample in samples(f"(?{flags}){pattern}" if flags else pattern, 1):
                searched = sample.lower() if "i" in flags else sample
                assert any(x in searched for x in literals or [""]), (pattern, sample)
    assert checked > 300


def test_own_replacement_characters_stay(spark):
    raw = spark.createDataFrame([(b"a\xef\xbf\xbdb\xffc",), (b"a\xef\xbf\xbdb",), (b"\xfe",)], "raw binary")
    assert [r[0] for r in raw.select(text.decode_utf8(F.col("raw"))).collect()] == ["a\ufffdbc", "a\ufffdb", ""]


def test_flags_within_a_pattern_give_up_required_strings():
    for pattern in (r"(?i)md5", r"(?x) foo bar", r"(?ix)md5"):
        assert patterns.required_literals(pattern) is None
    for pattern in (r"(?s)md5", r"(?m)md5", r"(?u)md5"):
        assert patterns.required_literals(pattern) == ["md5"]
    assert patterns.required_literals(r"(?i)MD5", True) == ["md5"]
    assert patterns.translated(r"\\Z\Z(?P<a_b>x)(?P=a_b)") == r"\\Z\z(?<g615f62>x)\k<g615f62>"


def test_source_rules_agree_with_python(make_files):
    """Each rule on its own examples, and every other rule of the language on them."""
    contents, expected = {}, []
    suffix = {}
    for extension, language in source_rules.EXTENSIONS.items():
        suffix.setdefault(language, extension)
    for language, rows in source_rules.LANGUAGES.items():
        lines = []
        for rule_id, _, pattern, *_ in rows:
            for sample in samples(pattern, 1) + samples(pattern, 1, one_line=True):
                lines.extend(sample.splitlines() or [""])
        body = "\n".join(lines)
        path = f"x/{language}{suffix[language]}"
        contents[path] = body
        for number, line in enumerate(body.splitlines(), 1):
            for rule_id, _, pattern, *_ in rows:
                if re.search(pattern, line):
                    expected.append((path, number, rule_id))
    found = places(detect_source(make_files(contents)))
    assert found == sorted(expected)
    assert len({rule for _, _, rule in found}) == 288


def test_secret_rules_agree_with_python(make_files):
    lines = [line for row in text_rules.SECRETS for sample in samples(row[1], 3) for line in sample.splitlines()]
    expected = [
        ("x/s.env.sh", n, row[0]) for n, line in enumerate(lines, 1) for row in text_rules.SECRETS if re.search(row[1], line)
    ]
    assert places(detect_secrets(make_files({"x/s.env.sh": "\n".join(lines)}))) == sorted(expected)


def test_suffixes(spark):
    names = ["a.py", ".env", "a.tar.gz", "Makefile", "x.", "b.JS", "..c"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(text.suffix_of(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in rows] == [".py", "", ".gz", "", "", ".JS", ".c"]


def test_globs(spark):
    cases = [
        (["build/"], "build/a.py", True), (["build/"], "x/build/a.py", True), (["build/"], "build", False),
        (["*.py"], "a/b.py", True), (["/a.py"], "b/a.py", False), (["/a.py"], "a.py", True),
        (["a/**/z.py"], "a/z.py", True), (["a/**/z.py"], "a/b/c/z.py", True), (["a/*.py"], "a/b/c.py", False),
        (["*.py", "!keep.py"], "x/keep.py", False), (["!keep.py", "*.py"], "x/keep.py", True),
        (["f?.go"], "f1.go", True), (["f?.go"], "f12.go", False), (["[ab].c"], "b.c", True), (["[!ab].c"], "b.c", False),
        (["# note", ""], "note", False), (["docs/**"], "docs/x/y", True), (["docs/**"], "docs", False),
    ]
    for excludes, path, verdict in cases:
        got = spark.range(1).select(globs.is_excluded(F.lit(path), excludes)).first()[0]
        assert got is verdict, (excludes, path)


def test_entropy(spark):
    rows = spark.createDataFrame([("",), ("aaaa",), ("abcd",), ("aabb",)], "t string").select(text.string_entropy(F.col("t"))).collect()
    assert [round(r[0], 6) for r in rows] == [0.0, 0.0, 2.0, 1.0]
