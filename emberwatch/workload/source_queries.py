"""Queries that write the events as log files and read them back, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.operators.stateless import stateless_rules
from emberwatch.schema import ts_text
from emberwatch.sources import store
from emberwatch.sources.event_xml import read_event_xml
from emberwatch.sources.json_logs import read_json_logs
from emberwatch.sources.siem_export import newer_than, read_siem_export
from emberwatch.sources.syslog import read_cef, read_syslog
from emberwatch.streaming import live
from emberwatch.streaming.detectors import live_detector
from emberwatch.workload.alert_sql import KEYED_SQL, ROW_SQL, SETTINGS, VIEW
from emberwatch.workload.event_queries import over_events
from emberwatch.workload.queries import alert_view, register
from emberwatch.workload.tables import sec_events

_written: dict[tuple[str, str, str], str] = {}


def log_files(spark: SparkSession, sf_dir: str, name: str, line: str) -> str:
    """Folder with one text line per event, written once per application. ``line`` is SQL."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = store.scratch_path(spark, name)
        sec_events(spark, sf_dir).selectExpr(f"{line} AS value").write.text(path)
        _written[key] = path
    return _written[key]


ISO_SECOND = "replace(substring(cast(event_ts as string), 1, 19), ' ', 'T')"
BSD = (
    "concat(element_at(array('Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'), month(event_ts)), ' ', "
    "lpad(cast(day(event_ts) as string), 2, ' '), substring(cast(event_ts as string), 11, 9))"
)
BASE_SQL = "strftime(event_ts, '%Y-%m-%d %H:%M:%S')"


def _time(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, ts_text("event_ts").alias("event_time"))


JSON_LINE = (
    "CASE WHEN event_uid LIKE '%9' THEN '{broken' WHEN event_uid LIKE '%8' THEN to_json(named_struct('event_id', 'none', 'id', event_uid)) "
    f"WHEN event_uid LIKE '%7' THEN to_json(named_struct('@timestamp', substring(cast(event_ts as string), 1, 19), 'event_id', event_id, "
    "'username', username, 'src_ip', source_ip, 'source', event_uid)) "
    f"ELSE to_json(named_struct('TimeCreated', concat({ISO_SECOND}, 'Z'), 'EventID', event_id, 'Source', event_uid, 'EventData', "
    "named_struct('SubjectUserName', username, 'IpAddress', source_ip, 'LogonType', logon_type))) END"
)


def _json(spark, sf_dir):
    return read_json_logs(spark, log_files(spark, sf_dir, "json", JSON_LINE), layout="lines")


@register(
    "read_json_logs",
    over_events(
        f"SELECT event_uid AS source, event_id, username, source_ip, category, CASE WHEN event_uid LIKE '%7' THEN 0 ELSE logon_type END AS logon_type, "
        f"{BASE_SQL} AS event_time FROM sec_events WHERE event_uid NOT LIKE '%8' AND event_uid NOT LIKE '%9'"
    ),
)
def json_logs(spark, sf_dir):
    return _time(_json(spark, sf_dir)[0], "source", "event_id", "username", "source_ip", "category", "logon_type")


@register(
    "quarantine",
    over_events(
        "SELECT CASE WHEN event_uid LIKE '%9' THEN 'malformed' ELSE 'bad number' END AS reason, count(*) AS n FROM sec_events "
        "WHERE event_uid LIKE '%8' OR event_uid LIKE '%9' GROUP BY 1"
    ),
)
def quarantine(spark, sf_dir):
    return _json(spark, sf_dir)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


MESSAGE = "concat(CASE WHEN event_id = 4625 THEN 'Failed password for ' ELSE 'Accepted password for ' END, 'bob', ' from ', source_ip, ' port 22')"


def _syslog_sql(source: str) -> str:
    return over_events(
        f"SELECT computer, CASE WHEN event_id = 4625 THEN 4625 ELSE 4624 END AS event_id, 'bob' AS username, source_ip, 'authentication' AS category, "
        f"{source} AS source, {BASE_SQL} AS event_time FROM sec_events WHERE source_ip <> ''"
    )


def _syslog(spark, sf_dir, name, line):
    events, _ = read_syslog(spark, log_files(spark, sf_dir, name, line), default_year=2024)
    return _time(events.where("source_ip <> ''"), "computer", "event_id", "username", "source_ip", "category", "source")


@register("read_syslog_3164", _syslog_sql("'sshd'"))
def syslog_3164(spark, sf_dir):
    return _syslog(spark, sf_dir, "rfc3164", f"concat('<34>', {BSD}, ' ', computer, ' sshd[12]: ', {MESSAGE})")


@register("read_syslog_5424", _syslog_sql("event_uid"))
def syslog_5424(spark, sf_dir):
    return _syslog(spark, sf_dir, "rfc5424", f"concat('<34>1 ', {ISO_SECOND}, '.5Z ', computer, ' ', event_uid, ' 7 - ', {MESSAGE})")


@register(
    "read_cef",
    over_events(
        f"SELECT event_id, computer, username, source_ip, CASE event_id % 11 WHEN 3 THEN 'authentication' WHEN 4 THEN 'authentication' "
        "WHEN 5 THEN 'network' WHEN 6 THEN 'process' WHEN 7 THEN 'privilege' WHEN 8 THEN 'privilege' WHEN 9 THEN 'privilege' WHEN 10 THEN 'privilege' "
        f"ELSE 'unknown' END AS category, 'a=b' || event_uid AS command_line, {BASE_SQL} AS event_time FROM sec_events"
    ),
)
def cef(spark, sf_dir):
    line = (
        "concat('CEF:0|Ven|Prod|1.0|', event_id, '|Some name|', event_id % 11, '|rt=', "
        "cast(unix_date(cast(event_ts as date)) as bigint) * 86400000 + hour(event_ts) * 3600000 + minute(event_ts) * 60000 "
        "+ cast(extract(SECOND FROM event_ts) * 1000 as bigint), ' dhost=', computer, ' suser=', username, ' src=', source_ip, "
        "' act=a\\\\=b', event_uid)"
    )
    events, _ = read_cef(spark, log_files(spark, sf_dir, "cef", line), default_year=2024)
    return _time(events, "event_id", "computer", "username", "source_ip", "category", "command_line")


@register(
    "read_event_xml",
    over_events(f"SELECT event_uid AS source, event_id, computer, username, source_ip, logon_type, {BASE_SQL} AS event_time FROM sec_events"),
)
def event_xml(spark, sf_dir):
    line = (
        "concat('<Event xmlns=\"urn:e\"><System><Provider Name=\"', event_uid, '\"/><EventID>', event_id, '</EventID><TimeCreated SystemTime=\"', "
        f"{ISO_SECOND}, 'Z\"/><Computer>', computer, '</Computer></System><EventData><Data Name=\"SubjectUserName\">', username, "
        "'</Data><Data Name=\"IpAddress\">', source_ip, '</Data><Data Name=\"LogonType\">', logon_type, '</Data></EventData></Event>')"
    )
    events, _ = read_event_xml(spark, log_files(spark, sf_dir, "xml", line), layout="lines")
    return _time(events, "source", "event_id", "computer", "username", "source_ip", "logon_type")


SIEM_PAGE = (
    f"concat('{{\"data\":{{\"affected_items\":[', to_json(named_struct('id', event_uid, 'timestamp', concat({ISO_SECOND}, '.000+0000'), "
    "'agent', named_struct('id', '001', 'name', computer), 'rule', named_struct('id', event_id, 'level', event_id % 17, "
    "'description', category, 'groups', array('', event_uid)), 'data', named_struct('srcip', source_ip, 'user', username))), ']}}')"
)


@register(
    "read_siem_export",
    over_events(
        f"SELECT event_uid AS process_name, event_id, computer, username, source_ip, category AS event_source, 'process' AS category, {BASE_SQL} AS event_time FROM sec_events"
    ),
)
def siem_export(spark, sf_dir):
    events, _ = read_siem_export(spark, log_files(spark, sf_dir, "siem", SIEM_PAGE), layout="lines")
    return _time(events, "process_name", "event_id", "computer", "username", "source_ip", "event_source", "category")


@register(
    "siem_new_alerts",
    over_events("SELECT username, count(*) AS n FROM sec_events WHERE CAST(event_uid AS BIGINT) > 2500 GROUP BY 1"),
)
def siem_new_alerts(spark, sf_dir):
    rows = sec_events(spark, sf_dir).select(F.col("event_uid").alias("id"), "username")
    return newer_than(rows, 2500).groupBy("username").agg(F.count(F.lit(1)).alias("n"))


# ---- streams ---------------------------------------------------------------------------


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there and return what it wrote."""
    out = store.scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def _stream_table(spark: SparkSession, sf_dir: str, name: str, copies: int = 1, closing: str | None = None) -> str:
    """Event folder for a stream. ``closing`` adds copies of the last matching event, a month later, as a
    second file: with it the watermark passes every window of the real events."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = store.scratch_path(spark, name)
        events = sec_events(spark, sf_dir)
        for _ in range(copies):
            events.write.mode("append").parquet(path)
        if closing is not None:
            last = events.where(closing).orderBy(F.col("event_ts").desc()).limit(1)
            last.withColumn("event_ts", F.expr("event_ts + INTERVAL '30' DAY")).write.mode("append").parquet(path)
        _written[key] = path
    return _written[key]


_STREAM_ROWS = " UNION ALL ".join(ROW_SQL.values())


@register("stream_row_alerts", over_events(f"SELECT {VIEW} FROM a", f"a AS ({_STREAM_ROWS})"))
def stream_row_alerts(spark, sf_dir):
    events = live.stream_event_table(spark, _stream_table(spark, sf_dir, "stream_once"), files_per_batch=4)
    return alert_view(_run(spark, live.live_alerts(events, stateless_rules(SETTINGS)), "stream_row_alerts"))


@register(
    "stream_log_lines",
    over_events("SELECT 'rule' AS kind, rule_name, count(*) AS n FROM a GROUP BY 2", "a AS (" + ROW_SQL["log_cleared"] + " AND event_uid NOT LIKE '%8' AND event_uid NOT LIKE '%9')"),
)
def stream_log_lines(spark, sf_dir):
    lines = live.stream_lines(spark, log_files(spark, sf_dir, "json", JSON_LINE), files_per_batch=2)
    rules = [r for r in stateless_rules(SETTINGS, ["defense_evasion"]) if r.rule_name == "Log Clearing Detected"]
    found = _run(spark, live.live_alerts(live.stream_log_events(lines, "json"), rules), "stream_log_lines")
    return found.groupBy(F.lit("rule").alias("kind"), "rule_name").agg(F.count(F.lit(1)).alias("n"))


@register(
    "stream_new_alerts",
    over_events("SELECT DISTINCT rule_name, strftime(alert_ts, '%Y-%m-%d %H:%M:%S') AS alert_time FROM a", f"a AS ({_STREAM_ROWS})"),
)
def stream_new_alerts(spark, sf_dir):
    """Every event arrives twice; each alert is reported once."""
    events = live.stream_event_table(spark, _stream_table(spark, sf_dir, "stream_twice", copies=2))
    found = _run(spark, live.new_alerts(live.live_alerts(events, stateless_rules(SETTINGS)), "60 days"), "stream_new_alerts")
    return found.select("rule_name", ts_text("alert_ts").alias("alert_time"))


@register("stream_new_events", over_events("SELECT event_uid FROM sec_events"))
def stream_new_events(spark, sf_dir):
    events = live.stream_event_table(spark, _stream_table(spark, sf_dir, "stream_twice", copies=2))
    return _run(spark, live.new_events(events, "60 days"), "stream_new_events").select("event_uid")


def _live(detector: str, closing: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _stream_table(spark, sf_dir, f"stream_{detector}", closing=closing)
        events = live.stream_event_table(spark, folder)
        return alert_view(_run(spark, live_detector(events, detector, SETTINGS, "1 minute"), f"live_{detector}"))

    return run


for _name, _closing in (
    ("brute_force", "event_id = 4625"),
    ("lateral_movement", "event_id = 4624 AND logon_type = 3 AND username LIKE 'user%'"),
    ("discovery", "process_name LIKE '%ipconfig.exe'"),
    ("dns_exfiltration", "event_id = 22 AND raw_json LIKE '%.x%'"),
    ("attack_chain", "event_id = 4625 AND username LIKE 'user%'"),
):
    _ctes, _select = KEYED_SQL[_name]
    register(f"stream_{_name}", over_events(f"SELECT {VIEW} FROM a", f"{_ctes}, a AS ({_select})"))(_live(_name, _closing))


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.stream_event_table(spark, _stream_table(spark, sf_dir, "stream_closed", closing="event_id >= 0"))


@register(
    "stream_tumbling",
    over_events("SELECT computer, strftime(date_trunc('hour', event_ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM sec_events GROUP BY ALL"),
)
def stream_tumbling(spark, sf_dir):
    """Events per host and hour, each hour once, when the watermark has passed it."""
    found = _run(spark, live.tumbling_counts(_closed(spark, sf_dir), ["computer"], "1 hour", "1 minute"), "stream_tumbling")
    return found.select("computer", ts_text("window_start").alias("window_start"), "n")


@register(
    "stream_sessions",
    over_events(
        "SELECT username, strftime(min(event_ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(event_ts), '%Y-%m-%d %H:%M:%S') AS session_end, "
        "count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY username ORDER BY event_ts RANGE UNBOUNDED PRECEDING) AS session FROM s) GROUP BY username, session",
        "s AS (SELECT username, event_ts, CASE WHEN event_ts <= lag(event_ts) OVER (PARTITION BY username ORDER BY event_ts, event_uid) + INTERVAL 30 MINUTE "
        "THEN 0 ELSE 1 END AS fresh FROM sec_events)",
    ),
)
def stream_sessions(spark, sf_dir):
    """Sessions of every user: a pause of half an hour ends one."""
    found = _run(spark, live.sessions(_closed(spark, sf_dir), ["username"], "30 minutes", "1 minute"), "stream_sessions")
    return found.select("username", ts_text("session_start").alias("session_start"), ts_text("session_end").alias("session_end"), "n")


def _export_folders(spark: SparkSession, sf_dir: str) -> str:
    """Export pages in two folders: the older alerts, and all alerts with the older pages delivered again."""
    key = (spark.sparkContext.applicationId, sf_dir, "export_pull")
    if key not in _written:
        path = store.scratch_path(spark, "export_pull")
        item = "to_json(named_struct('id', cast(event_uid as bigint), 'agent', named_struct('name', computer), 'data', named_struct('user', username)))"
        events = sec_events(spark, sf_dir)
        half = events.agg(F.max(F.expr("cast(event_uid as bigint)"))).first()[0] // 2
        for folder, rows in (("first", events.where(f"cast(event_uid as bigint) <= {half}")), ("second", events)):
            rows.select(F.expr(f"concat('{{\"data\":[', {item}, ',', {item}, ']}}') AS value")).write.text(f"{path}/{folder}")
        _written[key] = path
    return _written[key]


@register("siem_export_pull", over_events("SELECT CAST(event_uid AS BIGINT) AS id, computer, username FROM sec_events"))
def siem_export_pull(spark, sf_dir):
    """Exports read in two runs with one checkpoint; pages of the first come again in the second, and every alert twice a page."""
    out = store.scratch_path(spark, "siem_pull")
    folder = _export_folders(spark, sf_dir)
    for folders in ("{first}", "{first,second}"):
        alerts = live.pulled_once(live.stream_siem_alerts(spark, f"{folder}/{folders}"))
        query = (
            alerts.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    raw = F.try_parse_json("raw")
    return spark.read.parquet(f"{out}/data").select(
        "id", F.try_variant_get(raw, "$.agent.name", "string").alias("computer"), F.try_variant_get(raw, "$.data.user", "string").alias("username")
    )
