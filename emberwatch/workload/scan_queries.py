"""Queries over whole folders of logs, bad input, the configured scan, own detectors and batch scans of streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.operators.alerts import group_evidence
from emberwatch.operators.bursts import KEYED_DETECTORS
from emberwatch.operators.settings import CATALOG
from emberwatch.plans import registry
from emberwatch.plans.scan import ScanConfig, run_detections
from emberwatch.schema import ts_text
from emberwatch.sources import store
from emberwatch.sources.event_xml import read_event_xml
from emberwatch.sources.json_logs import read_json_logs
from emberwatch.sources.lines import discover_logs
from emberwatch.sources.logs import read_logs
from emberwatch.sources.siem_export import read_siem_export
from emberwatch.streaming import live
from emberwatch.workload.alert_queries import ALLOWLIST, REASON, alerts, over_alerts
from emberwatch.workload.alert_sql import SETTINGS, VIEW, window_ctes
from emberwatch.workload.event_queries import over_events
from emberwatch.workload.queries import alert_view, register
from emberwatch.workload.source_queries import BSD, ISO_SECOND, log_files
from emberwatch.workload.tables import sec_events

_folders: dict[tuple[str, str, str], str] = {}


def _written(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _folders:
        path = store.scratch_path(spark, name)
        write(sec_events(spark, sf_dir), path)
        _folders[key] = path
    return _folders[key]


def _plain(df: DataFrame, path: str, extension: str) -> None:
    """One text line per row in files with a three-letter extension."""
    df.write.option("extension", extension).option("quote", "\x00").option("escape", "\x00").option("sep", "\x01").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def _mixed(events: DataFrame, path: str) -> None:
    """A folder per format: JSON objects, syslog and CEF lines, event XML."""
    kind = F.expr("CAST(right(event_uid, 1) AS INT) % 4")
    events.where(kind == 0).selectExpr(
        f"concat({ISO_SECOND}, 'Z') AS TimeCreated", "event_id AS EventID", "computer AS Computer", "named_struct('SubjectUserName', username) AS EventData"
    ).write.json(f"{path}/a")
    _plain(events.where(kind == 1).selectExpr(f"concat('<34>', {BSD}, ' ', computer, ' sshd[1]: Failed password for bob from 10.0.0.1 port 22')"), f"{path}/b", "log")
    _plain(events.where(kind == 2).selectExpr(
        "concat('CEF:0|V|P|1|', event_id, '|n|5|rt=', cast(unix_date(cast(event_ts as date)) as bigint) * 86400000 + hour(event_ts) * 3600000 "
        "+ minute(event_ts) * 60000 + cast(floor(extract(SECOND FROM event_ts)) * 1000 as bigint), ' dhost=', computer, ' suser=', username)"
    ), f"{path}/c", "cef")
    events.where(kind == 3).selectExpr(
        f"named_struct('EventID', event_id, 'TimeCreated', named_struct('_SystemTime', concat({ISO_SECOND}, 'Z')), 'Computer', computer) AS System",
        "named_struct('Data', array(named_struct('_Name', 'SubjectUserName', '_VALUE', username))) AS EventData",
    ).write.format("xml").option("rootTag", "Events").option("rowTag", "Event").save(f"{path}/d")


def _folder(spark, sf_dir):
    return _written(spark, sf_dir, "mixed", _mixed)


@register(
    "discover_logs",
    over_events(
        "SELECT CASE CAST(right(event_uid, 1) AS INT) % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'syslog' WHEN 2 THEN 'cef' ELSE 'event_xml' END AS src_format, "
        "count(*) > 0 AS has_bytes FROM sec_events GROUP BY 1"
    ),
)
def discovered(spark, sf_dir):
    found = discover_logs(spark, _folder(spark, sf_dir), recursive=True)
    return found.groupBy("src_format").agg((F.sum("length") > 0).alias("has_bytes"))


@register(
    "read_mixed_folder",
    over_events(
        "SELECT CASE WHEN CAST(right(event_uid, 1) AS INT) % 4 = 1 THEN 4625 ELSE event_id END AS event_id, computer, "
        "CASE WHEN CAST(right(event_uid, 1) AS INT) % 4 = 1 THEN 'bob' ELSE username END AS username, "
        "strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_time FROM sec_events"
    ),
)
def read_mixed_folder(spark, sf_dir):
    events, bad = read_logs(spark, _folder(spark, sf_dir), default_year=2024, recursive=True)
    rows = events.select("event_id", "computer", "username", ts_text("event_ts").alias("event_time"))
    return rows.unionByName(bad.selectExpr("-1 AS event_id", "src_file AS computer", "reason AS username", "'' AS event_time"))


def _json_files(events: DataFrame, path: str) -> None:
    """Files of lines, one of which looks like an array's begin, and files that are one array each."""
    line = "CASE WHEN event_uid LIKE '%77' THEN '[truncated' ELSE to_json(named_struct('EventID', event_id, 'Source', event_uid)) END"
    events.where("CAST(right(event_uid, 1) AS INT) < 5").selectExpr(f"{line} AS value").write.text(f"{path}/lines")
    element = F.expr("to_json(named_struct('EventID', event_id, 'Source', event_uid))")
    packs = events.where("CAST(right(event_uid, 1) AS INT) >= 5").groupBy(F.expr("CAST(event_uid AS BIGINT) div 4000").alias("pack")).agg(
        F.array_join(F.array_sort(F.collect_list(element)), ",").alias("items")
    )
    packs.selectExpr("pack", "concat(' \n[', items, ']') AS value").write.partitionBy("pack").text(f"{path}/arrays")


@register(
    "read_json_auto",
    over_events("SELECT event_uid AS source, event_id FROM sec_events WHERE event_uid NOT LIKE '%77' OR CAST(right(event_uid, 1) AS INT) >= 5"),
)
def read_json_auto(spark, sf_dir):
    """Lines and arrays in one folder, told apart file by file."""
    path = _written(spark, sf_dir, "json_auto", _json_files)
    return read_json_logs(spark, path, recursiveFileLookup="true")[0].select("source", "event_id")


XML_OR_NOT = (
    "CASE WHEN event_uid LIKE '%9' THEN concat('stray ', event_uid) ELSE concat('<e:Event xmlns:e=\"urn:e\"><e:System><e:EventID>', event_id, "
    "'</e:EventID><e:Computer>', computer, '</e:Computer></e:System></e:Event>') END"
)


@register(
    "quarantine_xml",
    over_events("SELECT CASE WHEN event_uid LIKE '%9' THEN 'malformed' ELSE 'event' END AS kind, count(*) AS n FROM sec_events GROUP BY 1"),
)
def quarantine_xml(spark, sf_dir):
    events, bad = read_event_xml(spark, log_files(spark, sf_dir, "xml_or_not", XML_OR_NOT), layout="lines")
    kinds = events.select(F.lit("event").alias("kind")).unionByName(bad.select(F.col("reason").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


PAGES = (
    "CASE WHEN event_uid LIKE '%9' THEN '{\"data\": [' WHEN event_uid LIKE '%8' THEN to_json(named_struct('error', event_id)) "
    "ELSE concat('[', to_json(named_struct('id', event_uid)), ',', to_json(named_struct('id', event_uid)), ']') END"
)


@register(
    "quarantine_siem",
    over_events(
        "SELECT CASE WHEN event_uid LIKE '%9' THEN 'malformed' WHEN event_uid LIKE '%8' THEN 'no alerts' ELSE 'event' END AS kind, "
        "sum(CASE WHEN event_uid LIKE '%9' OR event_uid LIKE '%8' THEN 1 ELSE 2 END)::BIGINT AS n FROM sec_events GROUP BY 1"
    ),
)
def quarantine_siem(spark, sf_dir):
    events, bad = read_siem_export(spark, log_files(spark, sf_dir, "siem_pages", PAGES), layout="lines")
    kinds = events.select(F.lit("event").alias("kind")).unionByName(bad.select(F.col("reason").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register("scan_config", over_alerts(f"SELECT {VIEW} FROM alerts WHERE severity_rank >= 2 AND {REASON} IS NULL"))
def scan_config(spark, sf_dir):
    """The scan with an allowlist and a least severity."""
    return alert_view(run_detections(sec_events(spark, sf_dir), ScanConfig(settings=SETTINGS, allowlist=ALLOWLIST, min_severity="medium")))


WINDOW_RULES = ("brute_force", "lateral_movement", "discovery", "dns_exfiltration")


@register(
    "evidence_rows",
    over_alerts("SELECT alert_id, n, n AS n_events FROM alerts WHERE detector IN (" + ", ".join(f"'{d}'" for d in WINDOW_RULES) + ")"),
)
def evidence_rows(spark, sf_dir):
    """All evidence of window alerts, not only the rows that an alert shows."""
    rules = [KEYED_DETECTORS[d](SETTINGS) for d in WINDOW_RULES]
    rows = group_evidence(sec_events(spark, sf_dir), rules)
    return rows.groupBy("alert_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_uid").alias("n_events"))


@register(
    "detector_catalog",
    over_alerts(
        "SELECT c.detector, c.name, c.mitre_technique, count(a.detector) AS n_alerts FROM (VALUES "
        + ", ".join("('" + "', '".join((d, n.replace("'", "''"), t.replace("'", "''"))) + "')" for d, n, _, _, t in CATALOG)
        + ") AS c(detector, name, mitre_technique) LEFT JOIN alerts a ON a.detector = c.detector GROUP BY 1, 2, 3"
    ),
)
def detector_catalog(spark, sf_dir):
    """The catalog with the number of alerts of each detector."""
    counts = alerts(spark, sf_dir).groupBy("detector").agg(F.count(F.lit(1)).alias("n"))
    listed = registry.detector_catalog(spark).where(F.col("detector") != OWN)
    return listed.join(counts, "detector", "left").select("detector", "name", "mitre_technique", F.coalesce("n", F.lit(0)).alias("n_alerts"))


OWN = "remote_logon"


def _remote_logons(batch: pd.DataFrame) -> pd.DataFrame:
    """An own detector: one finding per remote interactive logon."""
    hit = batch[(batch["event_id"] == 4624) & (batch["logon_type"] == 10)]
    return pd.DataFrame({
        "rule_name": "Remote logon", "severity": "low", "description": "Logon of " + hit["username"] + " on " + hit["computer"], "alert_ts": hit["event_ts"],
        "mitre_tactic": "", "mitre_technique": "", "recommendation": "", "evidence_count": 1, "username": hit["username"], "computer": hit["computer"],
        "source_ip": hit["source_ip"],
    })


@register(
    "own_detector",
    over_events(
        "SELECT 'remote_logon' AS detector, 'Logon of ' || username || ' on ' || computer AS description, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS alert_time "
        "FROM sec_events WHERE event_id = 4624 AND logon_type = 10"
    ),
)
def own_detector(spark, sf_dir):
    """A registered own detector as the only one of a scan."""
    columns = ["event_id", "logon_type", "username", "computer", "source_ip", "event_ts"]
    if OWN not in dict(registry.registered_detectors()):
        registry.register_detector(OWN, registry.batch_detector(OWN, _remote_logons, columns))
    own = tuple(d for d in registry.registered_detectors() if d[0] == OWN)
    config = ScanConfig(settings=SETTINGS, detectors=own, exclude=tuple(d for d, *_ in CATALOG))
    found = run_detections(sec_events(spark, sf_dir), config)
    return found.select("detector", "description", ts_text("alert_ts").alias("alert_time"))


@register("stream_batch_scan", over_alerts(f"SELECT {VIEW} FROM alerts"))
def stream_batch_scan(spark, sf_dir):
    """All detectors over a stream's micro-batches; here one batch holds all events."""
    out = store.scratch_path(spark, "batch_scan")
    folder = _written(spark, sf_dir, "scan_input", lambda events, path: events.write.parquet(path))
    events = live.stream_event_table(spark, folder)
    query = live.start_batch_scan(
        events, lambda found, number: found.write.mode("append").parquet(f"{out}/alerts"), ScanConfig(settings=SETTINGS), f"{out}/checkpoint",
        availableNow=True,
    )
    query.awaitTermination()
    return alert_view(spark.read.parquet(f"{out}/alerts"))


def _late_files(events: DataFrame, path: str) -> None:
    """A folder of all events, and one of failed logons as they would have come forty days earlier."""
    events.write.parquet(f"{path}/first")
    late = events.where("event_id = 4625").withColumns({"event_uid": F.expr("concat('L', event_uid)"), "event_ts": F.expr("event_ts - INTERVAL '40' DAY")})
    late.write.parquet(f"{path}/behind")


@register(
    "late_events",
    over_events("SELECT 'L' || event_uid AS event_uid, strftime(event_ts - INTERVAL 40 DAY, '%Y-%m-%d %H:%M:%S') AS event_time FROM sec_events WHERE event_id = 4625"),
)
def late_events(spark, sf_dir):
    """Events behind the watermark are kept for the batch scan."""
    out = store.scratch_path(spark, "late")
    landed = _written(spark, sf_dir, "late_input", _late_files)
    for folders in ("{first}", "{first,behind}"):  # a run and a batch for each folder; one checkpoint knows the files it has seen
        events = live.stream_event_table(spark, f"{landed}/{folders}")
        live.start_late_router(events, out, 3600, f"{out}/checkpoint", availableNow=True).awaitTermination()
    return live.late_events(spark, out).select("event_uid", ts_text("event_ts").alias("event_time"))


class HostHops(registry.Sequence):
    """How often a user's events move on to another host."""

    def __init__(self):
        self.last = self.first = None
        self.hops = self.n = 0

    def add(self, events: pd.DataFrame) -> None:
        hosts = events["computer"]
        before = hosts.shift(fill_value=self.last if self.last is not None else hosts.iloc[0])
        self.hops += int((hosts != before).sum())
        self.n += len(hosts)
        self.last = hosts.iloc[-1]
        if self.first is None:
            self.first = events.iloc[0]

    def finding(self) -> dict | None:
        if self.hops < 3:
            return None
        return {
            "rule_name": "Host hopping", "severity": "low", "description": f"{self.first.username} moved {self.hops} times", "alert_ts": self.first.event_ts,
            "mitre_tactic": "", "mitre_technique": "", "recommendation": "", "evidence_count": self.n, "username": self.first.username,
            "computer": self.last, "source_ip": "",
        }


@register(
    "sequence_detector",
    over_events(
        "SELECT 'host_hops' AS detector, gk || ' moved ' || sum(hop) || ' times' AS description, strftime(w, '%Y-%m-%d %H:%M:%S') AS alert_time, count(*) AS n FROM ("
        "SELECT *, CASE WHEN computer <> lag(computer) OVER (PARTITION BY gk, w ORDER BY event_ts, event_uid) THEN 1 ELSE 0 END AS hop FROM hh_rows) "
        "GROUP BY gk, w HAVING sum(hop) >= 3",
        "hh AS (SELECT *, username AS gk FROM sec_events WHERE event_id = 4624), " + window_ctes("hh", "hh", 43200, 1),
    ),
)
def sequence_detector(spark, sf_dir):
    """An own detector over the logons of a user in order, one window of half a day at a time."""
    hops = registry.sequence_detector("host_hops", HostHops, "username", ["event_ts", "username", "computer"], 43200)
    config = ScanConfig(settings=SETTINGS, detectors=(("host_hops", hops),), exclude=tuple(d for d, *_ in CATALOG))
    found = run_detections(sec_events(spark, sf_dir).where("event_id = 4624"), config)
    return found.select("detector", "description", ts_text("alert_ts").alias("alert_time"), F.col("evidence_count").alias("n"))
