"""Files larger than a row: read by byte ranges, in pieces of whole lines.

Spark's text reader deals byte ranges of one file over tasks and gives each range the lines that begin in it. Consecutive
lines of a range are put together to pieces of bounded size, each a small file of its own to everything that reads texts.
A piece knows its range and its place in it, hence its order in the file. A line is never cut: it has to fit a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.functions import text
from cipherledger.sources.files import with_names

#: Bytes of a piece, but for the line that passes them.
PIECE_BYTES = 1_000_000
#: Pieces of one byte range are numbered below this.
RANGE_PIECES = 2**16


def read_pieces(spark: SparkSession, targets: list[str], *, name_glob: str | None = None, path: Column | None = None,
                piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``path, name, suffix, length, content, file_bytes, place, bytes``: files in pieces of whole lines.

    ``content`` holds a piece's lines as bytes, each with its line feed; ``bytes`` is its size with them, ``place`` orders
    the pieces of a file. ``path`` may rename files by their own ``path``. An empty file has no piece. A byte order mark
    at a file's start is not part of its first line.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    lines = reader.text(targets).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_bytes"),
        F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("line"),
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, 0
        for batch in batches:
            for run in _runs(batch):
                own = (run.column("path")[0].as_py(), run.column("range")[0].as_py())
                held, number = own, number if own == held else 0
                made = list(_pieces(run.column("line"), piece_bytes))
                if number + len(made) > RANGE_PIECES:
                    raise ValueError("too many pieces in a byte range; take larger pieces")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own[0]] * len(made)), pa.array([run.column("file_bytes")[0].as_py()] * len(made), pa.int64()),
                        pa.array([own[1] * RANGE_PIECES + number + i for i in range(len(made))], pa.int64()),
                        pa.array(made, pa.binary()),
                    ],
                    ["path", "file_bytes", "place", "content"],
                )
                number += len(made)

    pieces = lines.mapInArrow(fold, "path string, file_bytes long, place long, content binary")
    named = with_names(pieces if path is None else pieces.withColumn("path", path))
    size = F.octet_length("content").cast("long")
    return named.select("path", "name", "suffix", F.col("file_bytes").alias("length"), "content", "file_bytes", "place", size.alias("bytes"))


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch that come from one byte range of one file."""
    n = batch.num_rows
    if n > 1:
        apart = pc.or_(
            pc.not_equal(batch.column("path").slice(1), batch.column("path").slice(0, n - 1)),
            pc.not_equal(batch.column("range").slice(1), batch.column("range").slice(0, n - 1)),
        )
        cuts = [0, *(np.flatnonzero(apart.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
    else:
        cuts = [0, n]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _pieces(lines: pa.Array, piece_bytes: int) -> Iterator[bytes]:
    """Consecutive lines put together until they pass the bound, each with its line feed."""
    ends = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        stop = min(len(ends), int(np.searchsorted(ends, before + piece_bytes)) + 1)
        yield b"\n".join(lines.slice(at, stop - at).to_pylist()) + b"\n"
        at = stop


def decoded(pieces: DataFrame) -> DataFrame:
    """Pieces as text."""
    return pieces.withColumn("content", text.decode_utf8(F.col("content")))
