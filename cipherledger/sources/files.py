"""Reading file corpora."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.functions import globs, text


def with_names(files: DataFrame) -> DataFrame:
    """Add name and suffix to a table that has a path."""
    return files.withColumn("name", text.basename(F.col("path"))).withColumn("suffix", text.suffix_of(F.col("name")))


def _load(spark: SparkSession, targets: list[str], name_glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return with_names(reader.load(targets).select("path", "length", "content"))


def read_files(spark: SparkSession, target: str, *, excludes: list[str] = (), name_glob: str | None = None) -> DataFrame:
    """Every file below a directory, or one file, as (path, name, suffix, length, content bytes).

    Path, size and name filters act on the listing: only files that pass are
    opened. ``excludes`` are gitignore-style and relative to the target; a
    target that is itself a file is never excluded.
    """
    files = _load(spark, [target], name_glob)
    return _without(files, [target], excludes)


def _without(files: DataFrame, targets: list[str], excludes: list[str]) -> DataFrame:
    """Files that no exclude names, read relative to the target they lie in; of nested targets, the innermost."""
    if not excludes:
        return files
    relative = F.col("path")
    for target in sorted(targets, key=len):  # a longer one within a shorter one is asked first
        root = _plain_path(F.lit(target.rstrip("/")))
        inside = _is_inside(_plain_path(F.col("path")), root)
        relative = F.when(inside, relative_to(F.col("path"), target)).otherwise(relative)
    return files.where((relative == "") | ~globs.is_excluded(relative, list(excludes)))


def _plain_path(path: Column) -> Column:
    """A path without scheme and host, so that one spelling can be compared with another."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _is_inside(path: Column, root: Column) -> Column:
    """By whole segments: ``/a/bc`` is not inside ``/a/b``."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def relative_to(path: Column, target: str) -> Column:
    """Path below a target; empty for the target itself, the whole path outside it."""
    plain, root = _plain_path(path), _plain_path(F.lit(target.rstrip("/")))
    return F.when(_is_inside(plain, root), F.ltrim(F.substr(plain, F.length(root) + 1), F.lit("/"))).otherwise(path)


def read_targets(spark: SparkSession, targets: list[str], *, excludes: list[str] = (), name_glob: str | None = None) -> DataFrame:
    """Several targets by one reader; a target that does not exist has no files, one within another adds none."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    present = []
    for target in targets:
        where = jvm.org.apache.hadoop.fs.Path(target)
        if where.getFileSystem(conf).exists(where):
            present.append(target)
    if not present:
        return spark.createDataFrame([], "path string, length long, content binary, name string, suffix string")
    outer = [t for t in present if not any(o != t and _within(t, o) for o in present)]
    return _without(_load(spark, list(dict.fromkeys(outer)), name_glob), present, excludes)


def _within(target: str, other: str) -> bool:
    """Whether a target lies below another one."""
    return target.rstrip("/").startswith(other.rstrip("/") + "/")


def excluding(files: DataFrame, patterns: list[str], column: str = "path") -> DataFrame:
    """Drop files by gitignore-style patterns."""
    return files.where(~globs.is_excluded(F.col(column), patterns))


def as_text(files: DataFrame) -> DataFrame:
    """Contents decoded as UTF-8 without malformed bytes."""
    return files.withColumn("content", text.decode_utf8(F.col("content")))


def not_trivial(files: DataFrame, min_bytes: int = 0, max_bytes: int | None = None) -> DataFrame:
    """Neither blank nor outside the size bounds."""
    kept = files.where((F.col("length") >= min_bytes) & ~text.is_blank(F.col("content")))
    return kept if max_bytes is None else kept.where(F.col("length") <= max_bytes)
