"""Scans of files that are larger than a row (P1, L1, L2 with D1, D2, D8).

Pieces of whole lines are searched where they are read, once, each like a file of its own. What is kept of a piece is
small: its hits, how many lines and bytes it has, and its outermost lines. Line numbers come from a running sum over the
pieces' line counts; neighbours that lie in other pieces come from those pieces' outermost lines. Only then are
confidence and duplicates settled, inside the piece: a line lies in one piece only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions import text
from cipherledger.operators import detect_config, detect_text, enrich, post
from cipherledger.operators.hits import assemble, finished, with_arrays
from cipherledger.operators.running import SUM, running
from cipherledger.sources import long_files
from cipherledger.sources.rules import SourceRule
from cipherledger.sources.stored import written

#: The widest neighbourhood that a detector shows, and how wide each detector's is.
HALO = 3
#: Places of a split of a file: about ten thousand pieces of usual size.
SPLIT_PLACES = 10_000 * long_files.PIECE_BYTES * long_files.RANGE_PIECES
WIDTH = {"source": 2, "config": 2, "secrets": 3}


def searched(pieces: DataFrame, detectors: list[str], rules: list[SourceRule] | None = None, languages: list[str] | None = None,
             severities: list[str] | None = None) -> tuple[DataFrame, list]:
    """One row a piece: ``path, place, bytes, file_bytes, n_lines, head, tail, last_is_empty, hits``; and the hits' rules."""
    known = {
        "source": lambda: detect_text.source_detector(rules, languages, severities),
        "config": detect_config.ssh_detector,
        "secrets": detect_text.secrets_detector,
    }
    chosen = assemble([known[name]() for name in detectors])
    rows, every, all_rules = with_arrays(long_files.decoded(pieces), chosen, keep=["place", "bytes", "file_bytes"], cut=True)
    lines = F.col("lines")
    return rows.select(
        "path", "place", "bytes", "file_bytes", F.size(lines).cast("long").alias("n_lines"),
        F.slice(lines, 1, HALO).alias("head"),
        F.slice(lines, F.greatest(F.size(lines) - HALO + 1, F.lit(1)), F.lit(HALO)).alias("tail"),
        every.alias("hits"),
    ), all_rules


def around(found: DataFrame, split_places: int = SPLIT_PLACES) -> DataFrame:
    """Pieces with ``lines_before`` them, their own ``n_lines``, and the lines next to them in other pieces (``above``, ``below``)."""
    numbered = running(
        found, ["path"], "place",
        {"number": (F.lit(1), SUM), "lines_to": (F.col("n_lines"), SUM), "bytes_to": (F.col("bytes"), SUM)}, split_rows=split_places,
    )
    # a file's last line may have no line feed; if it ends with another kind of break, the feed put there made a line too many
    spare = ((F.col("bytes_to") > F.col("file_bytes")) & (F.element_at("tail", -1) == "")).cast("int")
    numbered = numbered.withColumn("spare", F.coalesce(spare, F.lit(0))).select(
        "path", "number", "hits", (F.col("n_lines") - F.col("spare")).alias("n_lines"), (F.col("lines_to") - F.col("n_lines")).alias("lines_before"),
        F.slice("head", F.lit(1), F.least(F.size("head"), (F.col("n_lines") - F.col("spare")).cast("int"))).alias("head"),
        F.slice("tail", F.lit(1), F.size("tail") - F.col("spare")).alias("tail"),
    )
    steps = [d for d in range(-HALO, HALO + 1) if d]  # pieces have a line at least, so so many pieces are enough
    lent = numbered.select("path", "number", F.inline(F.array(*[
        F.struct(F.lit(d).alias("step"), F.col("tail" if d < 0 else "head").alias("lines")) for d in steps
    ]))).select("path", (F.col("number") - F.col("step")).alias("number"), F.struct("step", "lines").alias("lent"))
    # six rows a piece at most
    gathered = lent.groupBy("path", "number").agg(F.sort_array(F.collect_list("lent")).alias("all"))

    def lines_of(keep) -> Column:
        return F.flatten(F.transform(F.filter("all", keep), lambda x: x["lines"]))

    edges = gathered.select(
        "path", "number", lines_of(lambda x: x["step"] < 0).alias("above"), lines_of(lambda x: x["step"] > 0).alias("below")
    )
    joined = numbered.drop("head", "tail").join(edges, ["path", "number"], "left")
    none = F.array().cast("array<string>")
    return joined.withColumns({side: F.coalesce(side, none) for side in ("above", "below")})


def scan_long_files(pieces: DataFrame, *, detectors: list[str] | None = None, min_severity: str = "info",
                    frameworks: list[str] | None = None, rules: list[SourceRule] | None = None,
                    languages: list[str] | None = None) -> DataFrame:
    """Findings of a scan over ``read_pieces``, as ``scan`` gives them for files of a row.

    Detectors that go line by line are run: source, secrets, SSH settings. The files are read when this is called; what it
    keeps is written to the shared folder, and findings come from there.
    """
    severities = None if min_severity == "info" else post.severities_from(min_severity)
    found, all_rules = searched(pieces, list(WIDTH) if detectors is None else detectors, rules, languages, severities)
    rows = around(written(found))
    widths = text.constant([WIDTH[r.scanner] for r in all_rules]) if all_rules else F.array(F.lit(0))
    # hits of a line that only the added line feed made are none
    real = F.filter("hits", lambda h: h["line_number"] <= F.col("n_lines"))
    moved = F.transform(real, lambda h: _moved(h, F.get(widths, h["rule_ord"])))
    done = finished(rows.select("path", moved.alias("hits")), all_rules)
    return done.transform(post.at_least, min_severity).transform(enrich.attach_compliance, frameworks)


def _moved(hit: Column, width: Column) -> Column:
    """A hit with its line's number in the file, and with the neighbours its piece does not hold."""
    number, n = hit["line_number"], F.col("n_lines").cast("int")
    above, below = F.col("above"), F.col("below")
    missing_above = F.least(F.greatest(width - (number - 1), F.lit(0)), F.size(above))
    missing_below = F.greatest(width - (n - number), F.lit(0))
    before = F.concat(F.slice(above, F.size(above) - missing_above + 1, missing_above), hit["context_before"])
    after = F.concat(F.slice(hit["context_after"], F.lit(1), F.greatest(n - number, F.lit(0))), F.slice(below, F.lit(1), missing_below))
    moved = F.col("lines_before")
    return F.struct(
        hit["rule_ord"].alias("rule_ord"), hit["tail"].alias("tail"), hit["subject"].alias("subject"),
        (number + moved).cast("int").alias("line_number"), hit["line"].alias("line"),
        before.alias("context_before"), after.alias("context_after"),
        (hit["a"] + moved).alias("a"), hit["b"].alias("b"), hit["c"].alias("c"),
    )
