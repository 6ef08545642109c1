import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """Files table from {path: text}."""
    from cipherledger.sources.files import with_names

    def make(contents):
        rows = [(path, len(text.encode()), text) for path, text in contents.items()]
        return with_names(spark.createDataFrame(rows, "path string, length long, content string"))

    return make


def places(findings):
    """Findings as a sorted list of (path, line, rule)."""
    rows = findings.select("location.file_path", "location.line_number", "rule_id").collect()
    return sorted((r[0], r[1], r[2]) for r in rows)
