"""One reader for a folder of mixed log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.schema import union_all
from emberwatch.sources.event_xml import read_event_xml
from emberwatch.sources.json_logs import read_json_logs
from emberwatch.sources.lines import discover_logs, file_options
from emberwatch.sources.syslog import read_cef, read_syslog


def read_logs(spark: SparkSession, path: str, default_year: int, formats: list[str] | None = None,
              recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of every log file below ``path``, by file extension."""
    if formats is None:
        found = discover_logs(spark, path, recursive).select("src_format").distinct()
        formats = sorted(r[0] for r in found.collect())
    readers = {
        "json": lambda options: read_json_logs(spark, path, **options),
        "syslog": lambda options: read_syslog(spark, path, default_year, **options),
        "cef": lambda options: read_cef(spark, path, default_year, **options),
        "event_xml": lambda options: read_event_xml(spark, path, **options),
    }
    binary = discover_logs(spark, path, recursive).where(F.lower("src_file").endswith(".evtx")).select(
        F.col("src_file").alias("value"), "src_file", F.lit(0).cast("bigint").alias("line_id"), F.lit("binary, export as XML").alias("reason")
    )
    parts = [readers[fmt](file_options(fmt, recursive)) for fmt in formats]
    if not parts:
        raise ValueError(f"no log files below {path}")
    return union_all([p[0] for p in parts]), union_all([*[p[1] for p in parts], binary])
