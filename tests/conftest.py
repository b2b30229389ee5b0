from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from emberwatch.schema import normalize_events  # noqa: E402

START = datetime(2024, 1, 15, 8, 30, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("emberwatch-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "America/New_York")  # nothing may depend on it
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


COLUMNS = [
    ("event_uid", "string"), ("event_ts", "timestamp_ntz"), ("event_id", "int"), ("category", "string"),
    ("computer", "string"), ("username", "string"), ("target_username", "string"), ("source_ip", "string"),
    ("process_name", "string"), ("command_line", "string"), ("logon_type", "int"), ("parent_process", "string"),
    ("raw_json", "string"),
]
CATEGORY = {4624: "authentication", 4625: "authentication", 4648: "authentication", 1: "process", 4688: "process", 4672: "privilege"}


class Events:
    """Builds event rows with an offset in seconds from a fixed start."""

    def __init__(self, spark):
        self.spark = spark

    def frame(self, rows):
        out = []
        for i, (seconds, event_id, fields) in enumerate(rows):
            row = {
                "event_uid": f"{i:06d}", "event_ts": START + timedelta(seconds=seconds), "event_id": event_id,
                "category": CATEGORY.get(event_id, "unknown"), "computer": "WS-PC01", "username": "jdoe",
                "logon_type": 0, "raw_json": "{}", **fields,
            }
            out.append(tuple(row.get(name, "" if kind == "string" else None) for name, kind in COLUMNS))
        return normalize_events(self.spark.createDataFrame(out, ", ".join(f"{n} {k}" for n, k in COLUMNS)))


@pytest.fixture(scope="session")
def events(spark):
    return Events(spark)
