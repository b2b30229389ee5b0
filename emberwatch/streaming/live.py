"""Live detection with Structured Streaming.

* :func:`live_alerts`: single-event rules in append mode, state-free.
* :func:`new_alerts`, :func:`new_events`: de-duplication with state bounded by a watermark.
* :func:`live_windows`: window rules per key carried over micro-batches, the attack chain
  among them; the same windows as in batch as long as no event is later than the watermark.
* :func:`tumbling_counts`, :func:`sessions`: counts per tumbling window and per session.
* :func:`start_batch_scan`: every detector on each micro-batch alone.
* :func:`start_late_router`: what the watermark would drop goes to a table for the batch scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from emberwatch.functions.events import event_fingerprint
from emberwatch.functions.sqltext import lit
from emberwatch.operators.alerts import DENSE, STAGES, GroupRule, group_alerts
from emberwatch.operators.rowrules import RowRule, run_row_rules
from emberwatch.operators.stateless import stateless_rules
from emberwatch.operators.windows import MICROS
from emberwatch.plans.scan import ScanConfig, run_detections
from emberwatch.schema import EVENT_DDL, EVIDENCE_DDL, computed_once, epoch_micros, evidence_sql, ts_text, with_raw
from emberwatch.sources.json_logs import split_records
from emberwatch.sources.siem_export import unwrap
from emberwatch.sources.store import scratch_scope
from emberwatch.sources.syslog import parse_lines
from emberwatch.streaming.stateful import FOUND_DDL, HighWater, WindowProcessor


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New lines of a folder of text files. The line id is a hash: streams have no row numbers."""
    reader = spark.readStream.format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(
        F.trim("value").alias("value"), F.col("_metadata.file_path").alias("src_file"),
        F.expr("xxhash64(value) & 9223372036854775807").alias("line_id"),
    ).where("value <> ''")


def stream_log_events(lines: DataFrame, fmt: str, default_year: int = 1970) -> DataFrame:
    """Events of streamed lines (``json``, ``syslog`` or ``cef``); unreadable lines are left out."""
    if fmt == "json":
        return split_records(computed_once(lines, raw=F.try_parse_json("value")))[0]
    return parse_lines(lines, default_year, cef_only=fmt == "cef")[0]


def stream_event_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New rows of a landed event table."""
    reader = spark.readStream.schema(EVENT_DDL)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def live_alerts(events: DataFrame, rules: list[RowRule] | None = None) -> DataFrame:
    """Alerts of single-event rules, as the events arrive."""
    return run_row_rules(events, rules if rules is not None else stateless_rules())


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Add the instant ``_at`` with a watermark: watermarks cannot sit on zone-less timestamps."""
    return df.withColumn("_at", F.timestamp_micros(epoch_micros(ts))).withWatermark("_at", delay)


def new_alerts(alerts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop an alert of the same rule and second as one seen within the delay."""
    return (
        watermarked(alerts, "alert_ts", delay).withColumn("_second", ts_text("alert_ts"))
        .dropDuplicatesWithinWatermark(["rule_name", "_second"]).drop("_second", "_at")
    )


def new_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop events with the fingerprint of one seen within the delay; keeps it as ``event_hash``."""
    hashed = events.withColumn("event_hash", event_fingerprint())
    return watermarked(hashed, "event_ts", delay).dropDuplicatesWithinWatermark(["event_hash"]).drop("_at")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def live_windows(events: DataFrame, rule: GroupRule, delay: str = "10 minutes") -> DataFrame:
    """Alerts of a window rule over a stream, as soon as each window is over.

    Dense and anchored rules give every window, stage rules the first one of each key. State
    is kept in slots of an eighth of the width (:mod:`emberwatch.streaming.stateful`) in
    RocksDB, which is set for the session's next streams; running checkpoints keep theirs.
    """
    if rule.kind not in (DENSE, STAGES):
        raise ValueError(f"{rule.detector} is not a window rule")
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    width = int(rule.width_seconds) * MICROS
    processor = WindowProcessor(width, rule.minimum, rule.names_shown, rule.evidence_cap, rule.kind == STAGES)
    rows = watermarked(with_raw(events, rule.raw).where(rule.test), "event_ts", delay).select(
        F.expr(f"{rule.key} AS key"), epoch_micros("event_ts").alias("t"), "_at", "event_uid", F.expr(f"{rule.value} AS value"),
        F.expr(f"cast({rule.bits} as int) AS bits"), F.expr(f"to_json({evidence_sql(**rule.evidence)}) AS item"),
    )
    found = rows.groupBy("key").transformWithStateInPandas(processor, FOUND_DDL, "Append", "EventTime")
    groups = found.selectExpr(
        "0 AS rule", "*", f"transform(items, x -> from_json(x, {lit(EVIDENCE_DDL)})) AS evidence", "cast(array() as array<string>) AS watch_hits",
    ).where(rule.having)
    return group_alerts(groups, [rule])


def stream_siem_alerts(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """(id, raw JSON text) of the alerts in new export files, one page per line; pages that cannot be read give none."""
    pages = computed_once(stream_lines(spark, path, files_per_batch), page=F.try_parse_json("value"))
    items = pages.select(F.explode(unwrap(F.col("page"))).alias("alert"))
    return items.select(F.try_variant_get("alert", "$.id", "bigint").alias("id"), F.to_json("alert").alias("raw")).where("id IS NOT NULL")


def pulled_once(alerts: DataFrame, id_column: str = "id", shards: int = 64) -> DataFrame:
    """Incremental pull of a stream of alerts: what re-delivered pages bring again is dropped.

    The highest id seen is kept as state, one mark for each of ``shards`` classes of ids, so
    the pull spreads over tasks. Ids grow at the source: one below its shard's mark counts as
    seen. ``id_column`` is a bigint; all columns have types that pandas knows.
    """
    alerts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    sharded = alerts.withColumn("shard", F.expr(f"cast(pmod({id_column}, {shards}) as int)"))
    return sharded.groupBy("shard").transformWithStateInPandas(HighWater(id_column), alerts.schema, "Append", "None")


def tumbling_counts(events: DataFrame, keys: list[str], width: str, delay: str = "10 minutes") -> DataFrame:
    """(keys, window_start, n) of each closed tumbling window; times are zone-less. :func:`start_late_router` keeps what comes too late."""
    counted = watermarked(events, "event_ts", delay).groupBy(F.window("_at", width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, _zoneless("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, keys: list[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    """(keys, session_start, session_end, n) of each closed session: a pause of ``gap`` ends it; the end is that of the last event."""
    counted = watermarked(events, "event_ts", delay).groupBy(F.session_window("_at", gap), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("event_ts").alias("session_end")
    )
    return counted.select(*keys, _zoneless("session_window.start").alias("session_start"), "session_end", "n")


def _zoneless(instant: str) -> Column:
    """Zone-less time of an instant that :func:`watermarked` made."""
    return F.expr(f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(unix_micros({instant}) / 1000000BD as decimal(18, 6)))")


def start_batch_scan(events: DataFrame, sink: Callable[[DataFrame, int], None], config: ScanConfig,
                     checkpoint: str, **trigger) -> StreamingQuery:
    """Run all detectors on every micro-batch by itself and hand the alerts to ``sink(alerts, batch_id)``.

    Bursts that span two micro-batches are missed here; :func:`live_windows` finds them. The
    sink has to write or collect the alerts: what they are computed from is deleted after it.
    """

    def scan(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            sink(run_detections(batch, config), batch_id)

    return events.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_late_router(events: DataFrame, folder: str, delay_seconds: int, checkpoint: str, **trigger) -> StreamingQuery:
    """Write events that come more than the delay behind the newest one of earlier batches to ``folder``.

    Those are the events that watermarks of that delay drop; :func:`late_events` reads them
    for the batch scan. Each batch writes its own sub-folder, so a repeated batch changes nothing.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = f"{folder}/newest"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(newest)
        before = None
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            seen = spark.read.schema("event_ts timestamp_ntz, batch bigint").parquet(newest).where(F.col("batch") < batch_id)
            before = seen.agg(F.max("event_ts")).first()[0]
        if before is not None:
            late = F.col("event_ts") < F.lit(str(before)).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(int(delay_seconds)))
            batch.where(late).write.mode("overwrite").parquet(f"{folder}/events/batch={batch_id}")
        batch.agg(F.max("event_ts").alias("event_ts")).write.mode("overwrite").parquet(f"{newest}/batch={batch_id}")

    return events.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def late_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events that :func:`start_late_router` set aside."""
    return spark.read.schema(EVENT_DDL).parquet(f"{folder}/events").drop("batch")
