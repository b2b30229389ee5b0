"""JSON logs: one object per line, or one array per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.events import event_category, first_field
from emberwatch.functions.timestamps import event_time, or_unknown
from emberwatch.schema import computed_once, normalize_events
from emberwatch.sources.arrays import array_elements, pieces_of
from emberwatch.sources.lines import line_uid, read_lines
from emberwatch.sources.store import materialize

# Record keys per event column, in order of preference.
FIELD_KEYS = {
    "event_id": ["EventID", "event_id", "EventId"],
    "time": ["TimeCreated", "timestamp", "Timestamp", "@timestamp", "time"],
    "source": ["Source", "source", "Provider", "Channel"],
    "computer": ["Computer", "computer", "ComputerName"],
    "username": ["SubjectUserName", "User", "username"],
    "domain": ["TargetDomainName", "SubjectDomainName", "Domain", "domain"],
    "source_ip": ["IpAddress", "SourceAddress", "source_ip", "src_ip"],
    "process_name": ["NewProcessName", "Image", "ProcessName", "process"],
    "command_line": ["CommandLine", "command_line", "ParentCommandLine"],
    "logon_type": ["LogonType", "logon_type"],
    "status": ["Status", "status", "Keywords"],
    "parent_process": ["ParentImage", "ParentProcessName", "parent_process"],
    "target_username": ["TargetUserName", "target_user"],
}
NUMBERS = ("event_id", "logon_type")


def array_files(pieces: DataFrame) -> DataFrame:
    """(src_file) of files whose first character that is not white space is ``[``."""
    head = pieces.select("src_file", "block", F.monotonically_increasing_id().alias("row"), F.substring(F.ltrim(F.translate("value", "\n\r\t\ufeff", "   ")), 1, 1).alias("head"))
    first = head.where("head <> ''").groupBy("src_file").agg(F.min_by("head", F.struct("block", "row")).alias("first"))
    return first.where(F.col("first") == "[").select("src_file")


def read_records(spark: SparkSession, path: str, layout: str = "auto", **options: str) -> DataFrame:
    """Records as (value JSON text, src_file, line_id, raw VARIANT); raw is NULL for malformed ones.

    ``layout`` is ``lines``, ``array`` or ``auto``. Naming it saves a look at the files. An
    array is cut into its elements wherever it is long (:mod:`emberwatch.sources.arrays`).
    """
    if layout == "lines":
        rows = read_lines(spark, path, **options)
    else:
        pieces = pieces_of(spark, path, **options)
        if layout == "array":
            rows = array_elements(pieces)
        else:
            # Names of files, written once: both sides below ask for them.
            arrays = materialize(array_files(pieces), "array-files")
            rows = read_lines(spark, path, **options).join(arrays, "src_file", "left_anti")
            if arrays.take(1):
                rows = rows.unionByName(array_elements(pieces, arrays))
    return computed_once(rows, raw=F.try_parse_json("value"))


def record_fields(records: DataFrame, field_keys: dict[str, list[str]] = FIELD_KEYS) -> DataFrame:
    """Add every event column as text, looked up by its keys."""
    return computed_once(
        records,
        **{
            name: first_field("raw", *keys, default="0" if name in NUMBERS else "")
            for name, keys in field_keys.items()
        },
    )


def good_numbers():
    """The record's event id and logon type are whole numbers."""
    return F.coalesce(
        F.col("event_id").try_cast("int").isNotNull() & F.col("logon_type").try_cast("int").isNotNull(), F.lit(False)
    )


def record_events(fields: DataFrame) -> DataFrame:
    """Event layout of records whose fields were looked up."""
    ts = event_time("time")
    number = F.col("event_id").try_cast("int")
    return normalize_events(
        fields.withColumns(
            {
                "event_uid": line_uid(),
                "event_ts": or_unknown(ts),
                "ts_valid": ts.isNotNull(),
                "category": event_category(number),
                "event_id": number,
                "logon_type": F.col("logon_type").try_cast("int"),
                "raw_json": F.col("value"),
            }
        )
    )


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine): bad records keep their text and do not stop the scan."""
    fields = record_fields(records)
    is_record = F.col("raw").isNotNull() & F.schema_of_variant("raw").startswith("OBJECT")
    ok = is_record & good_numbers()
    broken = F.when(F.col("value") == F.col("src_file"), "unreadable file").otherwise("malformed")
    reason = F.when(~F.coalesce(is_record, F.lit(False)), broken).otherwise("bad number")
    bad = fields.where(~F.coalesce(ok, F.lit(False))).select("value", "src_file", "line_id", reason.alias("reason"))
    return record_events(fields.where(ok)), bad


def read_json_logs(spark: SparkSession, path: str, layout: str = "auto", **options: str) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of JSON log files."""
    return split_records(read_records(spark, path, layout, **options))
