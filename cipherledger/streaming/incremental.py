"""Detectors over a stream of files.

Detection, confidence and compliance work on each file alone, so they take a
streaming DataFrame unchanged and keep no state. Duplicates are dropped within
each micro-batch: a file arrives whole, and so do its findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cipherledger.operators import enrich
from cipherledger.plans.scan import detect, finish
from cipherledger.sources.files import with_names

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, directory: str, per_trigger: int = 1000) -> DataFrame:
    """New files below a directory as a stream of (path, name, suffix, length, content)."""
    stream = (
        spark.readStream.format("binaryFile").schema(_FILES)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger)
        .load(directory)
    )
    return with_names(stream.select("path", "length", "content"))


def findings_of(files: DataFrame, detectors: list[str]) -> DataFrame:
    """Findings of a stream with confidence and compliance, before duplicates."""
    return detect(files, detectors=detectors).transform(enrich.adjust_confidence).transform(enrich.attach_compliance)


def scan_stream(files: DataFrame, output: str, checkpoint: str, detectors: list[str], min_severity: str = "info") -> StreamingQuery:
    """Write the finished findings of every micro-batch below ``output``.

    Each batch owns a directory named after its id and replaces it as a whole,
    so a batch that is run again after a failure leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        found = finish(detect(batch, detectors=detectors), min_severity)
        found.write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch={batch_id}")

    return (
        files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
