"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Texts and findings are stored once as parquet before the clock starts, as files
exist before a scan and findings before a report; every query then reads them
from disk and writes all its rows to a sink that keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from cipherledger.operators import aggregate, compare, enrich, migration, post  # noqa: E402
from cipherledger.operators.detect_text import detect_secrets, detect_source  # noqa: E402
from cipherledger.plans.scan import scan  # noqa: E402
from cipherledger.sources.findings import sarif_results  # noqa: E402
from verification import corpus  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TEXT_DETECTORS = ["source", "config", "dependency", "secrets", "iac", "container"]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("cipherledger-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # no Python call sites for error messages: plans are built in half the time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(result: DataFrame) -> None:
    result.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    work = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("BENCH_WORK_DIR", "/tmp"))
    store = f"{work}/files"
    corpus.CODE.files(spark, SF_DIR).repartition(4 * int(CPUS)).write.parquet(store)
    files = spark.read.parquet(store)
    count = files.count()
    corpus.facts(spark, SF_DIR).repartition(4 * int(CPUS)).write.parquet(f"{work}/findings")

    def found():
        return spark.read.parquet(f"{work}/findings")

    def two():
        return found().where("scan_id = '1996'"), found().where("scan_id = '1998'")

    headline = {
        "detect_source": lambda: detect_source(files),
        "detect_secrets": lambda: detect_secrets(files),
        "full_scan": lambda: scan(files, detectors=TEXT_DETECTORS),
        "deduplicate": lambda: post.deduplicate(found()),
        "confidence": lambda: enrich.adjust_confidence(found()),
        "compliance": lambda: enrich.attach_compliance(found()),
        "scan_summary": lambda: aggregate.summarise(found()),
        "crypto_inventory": lambda: aggregate.crypto_inventory(found()),
        "compliance_gaps": lambda: aggregate.compliance_gaps(found()),
        "crypto_debt": lambda: aggregate.crypto_debt(found()),
        "migration_tasks": lambda: migration.migration_tasks(found()),
        "new_findings": lambda: compare.new_findings(*two()),
        "sarif_results": lambda: sarif_results(found()),
    }
    times = {}
    for name, make in headline.items():
        best = None
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            drain(make())
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "files": count,
        "files_per_second": {name: round(count / times[name]) for name in ("detect_source", "detect_secrets", "full_scan")},
    }))


if __name__ == "__main__":
    main()
