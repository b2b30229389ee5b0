"""Parquet tables of the engine: landed events, alerts, incidents, reports, hash chain.

Landing the parsed events once is what makes every later scan cheap: filters on
``event_id`` and ``event_date`` reach the Parquet reader and unused columns are not read.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.schema import ts_text, with_raw

PARTITION_COLUMN = "event_date"


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting (tests) gets a temporary folder: executors
    of a cluster would each write to a folder of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="emberwatch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, unique to this application and call."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"


_scope: ContextVar[list[str] | None] = ContextVar("scratch tables of this scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`materialize` writes inside are deleted at the end. For work that repeats, such as batches of a stream."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in made:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss.

    With ``partition_by`` each value of that column gets a folder, which filters on it read alone.
    """
    path = scratch_path(df.sparkSession, name)
    if (made := _scope.get()) is not None:
        made.append(path)
    df.write.parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession, prefix: str = "") -> None:
    """Delete this application's intermediate tables whose names begin with ``prefix``.

    Call it when nothing reads them any more: at the end of a batch or of the application.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.listStatus(top) if files.exists(top) else []:
        if found.getPath().getName().startswith(prefix):
            files.delete(found.getPath(), True)


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core, so that a small input does not land as a single file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def write_events(events: DataFrame, path: str, mode: str = "append", parsed: bool = False) -> None:
    """Append events, one folder per day. Rows of a day are spread over many files.

    With ``parsed`` the raw record is stored as VARIANT too: passes with rules over raw fields
    then read it instead of parsing the text.
    """
    with_raw(events, parsed).withColumn(PARTITION_COLUMN, F.to_date("event_ts")).write.mode(mode).partitionBy(
        PARTITION_COLUMN
    ).parquet(path)


def read_events(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Landed events, optionally of the days ``since`` to ``until`` (both included)."""
    df = spark.read.parquet(path)
    if since is not None:
        df = df.where(F.col(PARTITION_COLUMN) >= F.lit(since).cast("date"))
    if until is not None:
        df = df.where(F.col(PARTITION_COLUMN) <= F.lit(until).cast("date"))
    return df.drop(PARTITION_COLUMN)


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Alerts in store form: times cut to the second, partition date added."""
    whole = ts_text("alert_ts").cast("timestamp_ntz")
    return alerts.withColumn("alert_ts", whole).withColumn("alert_date", F.to_date("alert_ts"))


def mitre_rows(alerts: DataFrame) -> DataFrame:
    """One mapping row per alert that has an ATT&CK label."""
    return alerts.where((F.col("mitre_tactic") != "") | (F.col("mitre_technique") != "")).select(
        F.lit("alert").alias("source"),
        F.col("mitre_tactic").alias("tactic"),
        F.col("mitre_technique").alias("technique"),
        "rule_name",
        F.to_date("alert_ts").alias("alert_date"),
    )


def save_alerts(alerts: DataFrame, folder: str) -> None:
    """Append alerts and their ATT&CK mapping rows."""
    alert_rows(alerts).write.mode("append").partitionBy("alert_date").parquet(f"{folder}/alerts")
    stored = mitre_rows(alerts)
    stored.write.mode("append").partitionBy("alert_date").parquet(f"{folder}/mitre_mappings")


def save_incidents(incidents: DataFrame, folder: str) -> None:
    incidents.withColumn("incident_date", F.to_date("created_at")).write.mode("append").partitionBy(
        "incident_date"
    ).parquet(f"{folder}/incidents")


def save_report(spark: SparkSession, folder: str, report_type: str, output_path: str, payload: Column) -> None:
    """Append one line to the report log."""
    spark.range(1).select(
        F.current_timestamp().cast("timestamp_ntz").alias("created_at"),
        F.lit(report_type).alias("report_type"),
        F.lit(output_path).alias("output_path"),
        payload.cast("string").alias("payload"),
    ).write.mode("append").parquet(f"{folder}/reports")


def scan_table(spark: SparkSession, path: str, order: list[str], limit: int | None = None,
               where: Column | None = None) -> DataFrame:
    """Stored rows in order. With ``limit`` Spark keeps only the top rows of each task."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)
