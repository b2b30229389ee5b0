"""Reading text files as rows of (value, src_file, line_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions of the input formats; anything else is read as JSON.
EXTENSIONS = {
    ".json": "json", ".ndjson": "json", ".jsonl": "json",
    ".evtx": "event_xml", ".xml": "event_xml",
    ".log": "syslog", ".syslog": "syslog",
    ".cef": "cef",
}
GLOBS = {
    "json": "*.{json,ndjson,jsonl}",
    "syslog": "*.{log,syslog}",
    "cef": "*.cef",
    "event_xml": "*.xml",
}


def format_of(path: str | Column) -> Column:
    """Input format by file extension."""
    path = F.col(path) if isinstance(path, str) else path
    suffix = F.concat(F.lit("."), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))
    pairs = [F.lit(x) for item in EXTENSIONS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), suffix), F.lit("json"))


def file_options(fmt: str | None = None, recursive: bool = False) -> dict[str, str]:
    options = {"recursiveFileLookup": str(recursive).lower()}
    if fmt is not None:
        options["pathGlobFilter"] = GLOBS[fmt]
    return options


def discover_logs(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """The log files below ``path`` with format and size; file contents are not read."""
    known = "*.{" + ",".join(e[1:] for e in EXTENSIONS) + "}"
    files = (
        spark.read.format("binaryFile").options(**file_options(None, recursive))
        .option("pathGlobFilter", known).load(path)
    )
    return files.select(F.col("path").alias("src_file"), format_of("path").alias("src_format"), "length")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of a file reader with ``src_file`` and ``line_id``, the number of the row in its file.

    The numbers depend neither on other files nor on how files are split: a first pass counts
    the rows of each byte range, which reads no column, and running sums over a file's ranges
    tell where each begins.
    """
    placed = rows.select(
        "*", F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")
    )
    ranges = placed.groupBy("src_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    begins = ranges.selectExpr(
        "src_file", "_block", "_first", "coalesce(sum(_n) OVER (PARTITION BY src_file ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _begin"
    )
    # One row per byte range; a broadcast join leaves the rows with the task that read them.
    return placed.join(F.broadcast(begins), ["src_file", "_block"]).withColumn("line_id", F.expr("_begin + _at - _first")).select(*rows.columns, "src_file", "line_id")


def read_lines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """Non-blank lines, trimmed. Long files are split over many tasks."""
    lines = numbered(spark.read.options(**options).text(path))
    return lines.select(F.trim("value").alias("value"), "src_file", "line_id").where(F.col("value") != "")


def line_uid() -> Column:
    """Event id that sorts like the input: line id, then file."""
    return F.concat_ws("@", F.lpad(F.col("line_id").cast("string"), 20, "0"), F.col("src_file"))
