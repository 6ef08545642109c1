"""Stored scans: findings, keys laid out for comparison, and a summary that can be carried on.

Below a scan's folder lie three tables. ``findings`` has all findings. ``keys`` has one row for each rule, file and
algorithm, in buckets of that key: two scans with as many buckets are compared bucket by bucket, without a shuffle, and a
key that many findings share is one row already. ``state`` has counts by file, severity and risk; they give the summary and
follow later changes. ``about`` says what was scanned and when.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.operators import aggregate
from cipherledger.operators.compare import KEY, keyed
from cipherledger.sources.findings import read_findings, write_findings

#: Buckets of the keys; scans that are compared should have the same number.
BUCKETS = 64
KEY_DDL = "rule_id string, file_path string, algorithm_name string, severity string, quantum_risk string, line_number int, message string"


@dataclass(frozen=True)
class StoredScan:
    """The tables of a stored scan, read when they are used."""

    findings: DataFrame
    keys: DataFrame
    state: DataFrame
    about: DataFrame

    @property
    def summary(self) -> DataFrame:
        """One row: counts, score, grade, readiness (A1 to A3), with what was scanned."""
        return self.about.crossJoin(F.broadcast(aggregate.summary_of_state(self.state)))


def _table_name(path: str) -> str:
    return "scan_keys_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def write_scan(findings: DataFrame, path: str, targets: list[str], at: datetime, scan_id: str | None = None, buckets: int = BUCKETS) -> StoredScan:
    """Store a scan below ``path``, which must be new, and read it back. Keys and state come from the stored findings."""
    spark, root = findings.sparkSession, path.rstrip("/")
    write_findings(findings, f"{root}/findings", "parquet")
    stored = read_findings(spark, f"{root}/findings")
    keys = keyed(stored).drop("ord").select(*[c.split()[0] for c in KEY_DDL.split(", ")])
    name = _table_name(root)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    # a task per bucket, so that a bucket is one file
    keys.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", f"{root}/keys").saveAsTable(name)
    aggregate.summary_state(stored).write.parquet(f"{root}/state")
    about = spark.createDataFrame([(scan_id or root, targets, at, buckets)], "scan_id string, targets array<string>, ts timestamp, buckets int")
    about.write.parquet(f"{root}/about")
    return read_scan(spark, root)


def read_scan(spark: SparkSession, path: str) -> StoredScan:
    """A stored scan; its keys come with their buckets, in any session."""
    root = path.rstrip("/")
    about = spark.read.parquet(f"{root}/about")
    name = _table_name(root)
    if not spark.catalog.tableExists(name):
        buckets = about.first()["buckets"]
        key = ", ".join(KEY)
        place = f"{root}/keys".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({KEY_DDL}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return StoredScan(read_findings(spark, f"{root}/findings"), spark.table(name), spark.read.parquet(f"{root}/state"), about.drop("buckets"))
