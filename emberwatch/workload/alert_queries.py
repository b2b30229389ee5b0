"""Queries over the alerts of a full scan: post-processing, correlation, reports, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.operators import correlate as co
from emberwatch.operators import post
from emberwatch.operators.rowrules import run_row_rules
from emberwatch.operators.stateless import stateless_rules
from emberwatch.plans import payloads, reports
from emberwatch.plans.scan import ScanConfig, run_detections, scan_alerts
from emberwatch.schema import ts_text
from emberwatch.sources import store
from emberwatch.workload.alert_sql import ALERTS_CTE, SETTINGS, VIEW
from emberwatch.workload.queries import alert_view, register
from emberwatch.workload.tables import sec_events

_alerts: dict[tuple[str, str], DataFrame] = {}


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_detections(sec_events(spark, sf_dir), ScanConfig(settings=SETTINGS))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the full scan, stored once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _alerts:
        _alerts[key] = store.materialize(scan(spark, sf_dir), "alerts")
    return _alerts[key]


def over_alerts(select: str, ctes: str = "") -> str:
    return f"WITH RECURSIVE {ALERTS_CTE}{', ' + ctes if ctes else ''} {select}"


@register("scan_all", over_alerts(f"SELECT alert_id, {VIEW} FROM alerts"))
def scan_all(spark, sf_dir):
    found = scan(spark, sf_dir)
    return found.select("alert_id", *alert_view(found).columns[:4], ts_text("alert_ts").alias("alert_time"),
                        "mitre_tactic", "mitre_technique", "evidence_count")


@register("min_severity_high", over_alerts(f"SELECT {VIEW} FROM alerts WHERE severity_rank >= 3"))
def min_severity_high(spark, sf_dir):
    return alert_view(post.at_least(alerts(spark, sf_dir), "high"))


@register(
    "facet_filter",
    over_alerts(
        f"SELECT {VIEW} FROM alerts WHERE severity IN ('high', 'critical') AND mitre_tactic IN ('Persistence', 'Defense Evasion') "
        "AND rule_name IN ('New Service Created', 'Log Clearing Detected', 'Registry Run Key Modified') AND host IN ('host1', 'host7')"
    ),
)
def facet_filter(spark, sf_dir):
    return alert_view(
        post.facet_filter(
            alerts(spark, sf_dir), ["high", "critical"], ["Persistence", "Defense Evasion"],
            ["New Service Created", "Log Clearing Detected", "Registry Run Key Modified"], ["host1", "host7"],
        )
    )


ALLOWLIST = (
    {"rule_name": "log CLEARING", "computer": "HOST3", "reason": "maintenance"},
    {"username": "User5", "severity": "low"},
    {"event_id": 7045, "computer": "host7", "reason": "rollout"},
    {"mitre_technique": "t1562.004", "reason": None},
    {"source_ip": "185.220.101.2", "reason": "pentest"},
)
REASON = (
    "CASE WHEN contains(lower(rule_name), 'log clearing') AND host = 'host3' THEN 'maintenance' "
    "WHEN severity = 'low' AND lower(\"user\") = 'user5' THEN 'allowlisted' "
    "WHEN rule_name = 'New Service Created' AND host = 'host7' THEN 'rollout' "
    "WHEN contains(upper(mitre_technique), 'T1562.004') THEN 'allowlisted' "
    "WHEN list_contains(ips, '185.220.101.2') THEN 'pentest' END"
)


def _allowlisted(spark, sf_dir):
    return scan_alerts(sec_events(spark, sf_dir), ScanConfig(settings=SETTINGS, allowlist=ALLOWLIST))


@register("allowlist_kept", over_alerts(f"SELECT {VIEW} FROM alerts WHERE {REASON} IS NULL"))
def allowlist_kept(spark, sf_dir):
    return alert_view(_allowlisted(spark, sf_dir)[0])


@register(
    "suppression_stats",
    over_alerts(f"SELECT {REASON} AS reason, count(*) AS n FROM alerts WHERE {REASON} IS NOT NULL GROUP BY 1"),
)
def suppression_stats(spark, sf_dir):
    return post.suppression_stats(_allowlisted(spark, sf_dir)[1])


@register(
    "ranked_alerts",
    over_alerts(f"SELECT {VIEW}, CAST(severity_rank AS BIGINT) AS severity_rank FROM alerts ORDER BY severity_rank DESC, alert_ts, alert_id"),
)
def ranked_alerts(spark, sf_dir):
    ranked = post.rank_alerts(alerts(spark, sf_dir))
    return ranked.select(
        "detector", "rule_name", "severity", "description", ts_text("alert_ts").alias("alert_time"), "mitre_tactic",
        "mitre_technique", "evidence_count", F.col("severity_rank").cast("bigint").alias("severity_rank"),
    )


@register(
    "dedup_alerts",
    over_alerts(
        f"SELECT {VIEW} FROM (SELECT *, row_number() OVER (PARTITION BY rule_name, strftime(alert_ts, '%Y-%m-%d %H:%M:%S') "
        "ORDER BY alert_ts, alert_id) AS rn FROM alerts) WHERE rn = 1"
    ),
)
def dedup_alerts(spark, sf_dir):
    return alert_view(post.dedup_alerts(alerts(spark, sf_dir)))


@register("fail_on_critical", over_alerts("SELECT max(severity_rank) >= 4 AS actionable FROM alerts"))
def fail_on_critical(spark, sf_dir):
    return post.any_at_least(alerts(spark, sf_dir), "critical")


@register(
    "severity_summary",
    over_alerts(
        "SELECT s.severity, count(a.severity) AS n FROM (VALUES ('info'), ('low'), ('medium'), ('high'), ('critical')) "
        "AS s(severity) LEFT JOIN alerts a ON a.severity = s.severity GROUP BY 1"
    ),
)
def severity_summary(spark, sf_dir):
    return reports.severity_summary(alerts(spark, sf_dir))


@register(
    "top_rules",
    over_alerts(
        "SELECT rule_name, count(*) AS n, strftime(min(alert_ts), '%Y-%m-%d %H:%M:%S') AS first_time FROM alerts "
        "GROUP BY 1 ORDER BY n DESC, min(alert_ts), rule_name LIMIT 5"
    ),
)
def top_rules(spark, sf_dir):
    return reports.top_rules(alerts(spark, sf_dir)).select("rule_name", "n", ts_text("first_ts").alias("first_time"))


_TACTICS = ", ".join(f"'{t}'" for t in reports.TACTICS)


@register(
    "tactic_matrix",
    over_alerts(
        "SELECT mitre_tactic, mitre_technique, n, CAST(sum(n) OVER (PARTITION BY mitre_tactic) AS BIGINT) AS tactic_total, "
        f"(SELECT max(n) FROM cells) AS largest FROM cells WHERE mitre_tactic IN ({_TACTICS})",
        "cells AS (SELECT mitre_tactic, mitre_technique, count(*) AS n FROM alerts GROUP BY 1, 2)",
    ),
)
def tactic_matrix(spark, sf_dir):
    return reports.tactic_matrix(alerts(spark, sf_dir))


@register(
    "tactic_spread",
    over_alerts("SELECT CASE WHEN mitre_tactic = '' THEN 'Uncategorized' ELSE mitre_tactic END AS tactic, count(*) AS n FROM alerts GROUP BY 1"),
)
def tactic_spread(spark, sf_dir):
    return reports.tactic_spread(alerts(spark, sf_dir))


@register(
    "label_ranking",
    over_alerts(
        "SELECT label, count(*) AS n FROM (SELECT mitre_tactic AS label FROM alerts UNION ALL SELECT mitre_technique FROM alerts) "
        "WHERE label <> '' GROUP BY 1 ORDER BY n DESC, label LIMIT 20"
    ),
)
def label_ranking(spark, sf_dir):
    return reports.label_ranking(alerts(spark, sf_dir))


@register(
    "technique_layer",
    over_alerts(
        "SELECT technique_id, n AS score, n || ' alert(s) across ' || len(rules) || ' rule(s): ' || array_to_string(rules[1:5], ', ') || "
        "CASE WHEN len(rules) > 5 THEN ' ...' ELSE '' END || '. Severities: ' || array_to_string(sev, ', ') || '.' AS comment, "
        "array_to_string(rules[1:10], ', ') AS rules, contains(technique_id, '.') AS is_subtechnique, max(n) OVER () AS max_score FROM g",
        "h AS (SELECT unnest(regexp_extract_all(mitre_technique || ' ' || mitre_tactic, 'T[0-9]{4}(?:[.][0-9]{3})?')) AS technique_id, rule_name, severity FROM alerts), "
        "g AS (SELECT technique_id, count(*) AS n, list_sort(list(DISTINCT rule_name)) AS rules, list_sort(list(DISTINCT severity)) AS sev FROM h GROUP BY 1)",
    ),
)
def technique_layer(spark, sf_dir):
    return reports.technique_layer(alerts(spark, sf_dir))


@register(
    "timeline",
    over_alerts(
        "SELECT alert_id, rule_name, severity, round(o / 1000000.0, 6) AS offset_seconds, round(CAST(o AS DOUBLE) / span, 9) AS fraction FROM "
        "(SELECT *, epoch_us(alert_ts) - min(epoch_us(alert_ts)) OVER () AS o, max(epoch_us(alert_ts)) OVER () - min(epoch_us(alert_ts)) OVER () AS span FROM alerts)"
    ),
)
def timeline(spark, sf_dir):
    return reports.timeline(alerts(spark, sf_dir)).select(
        "alert_id", "rule_name", "severity", F.round("offset_seconds", 6).alias("offset_seconds"), F.round("fraction", 9).alias("fraction")
    )


@register(
    "timeline_ticks",
    over_alerts(
        "SELECT i AS tick, CAST(floor(i / 8.0 * (hi - lo) / 1000000.0) AS BIGINT) AS tick_seconds FROM "
        "(SELECT min(epoch_us(alert_ts)) AS lo, max(epoch_us(alert_ts)) AS hi FROM alerts), range(0, 9) t(i)"
    ),
)
def timeline_ticks(spark, sf_dir):
    found = alerts(spark, sf_dir)
    first, _ = reports._bounds(found)
    ticks = reports.timeline_ticks(found)
    return ticks.select(
        F.col("tick").cast("bigint").alias("tick"),
        F.floor((F.col("tick_micros") - first) / 1_000_000).cast("bigint").alias("tick_seconds"),
    )


@register(
    "detection_rate",
    over_alerts(
        "SELECT f.computer AS directory, count(*) AS files, count(*) FILTER (WHERE n > 0) AS files_with_alerts, "
        "CAST(coalesce(sum(n), 0) AS BIGINT) AS alerts, CAST(round_even(count(*) FILTER (WHERE n > 0) * 100.0 / count(*), 0) AS BIGINT) AS rate "
        "FROM (SELECT DISTINCT computer, source FROM sec_events) f LEFT JOIN "
        "(SELECT host, count(*) AS n FROM alerts WHERE rule_name = 'New Service Created' GROUP BY 1) a "
        "ON a.host = f.computer AND f.source = 'auditing-purchase' GROUP BY 1"
    ),
)
def detection_rate(spark, sf_dir):
    files = sec_events(spark, sf_dir).select(F.concat("computer", F.lit("/"), "source").alias("src_file"))
    hits = (
        alerts(spark, sf_dir).where(F.col("rule_name") == "New Service Created")
        .groupBy(F.concat(F.col("evidence")[0]["computer"], F.lit("/auditing-purchase")).alias("src_file"))
        .agg(F.count(F.lit(1)).alias("n_alerts"))
    )
    return reports.detection_rate(files, hits)


@register("detector_profile", over_alerts("SELECT detector, count(*) AS n FROM alerts GROUP BY 1"))
def detector_profile(spark, sf_dir):
    return reports.detector_profile(alerts(spark, sf_dir))


# ---- correlation -----------------------------------------------------------------------

STAGE_SQL = "CASE " + " ".join(
    f"WHEN contains(lower(rule_name || ' ' || description || ' ' || mitre_technique), '{word}') THEN '{stage}'"
    for word, stage in co.STAGE_KEYWORDS.items()
) + " WHEN mitre_technique <> '' THEN mitre_technique ELSE 'General Alert' END"
WEIGHT_SQL = "CASE severity " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in co.SEVERITY_WEIGHTS.items()) + " ELSE 0 END"
ENTITIES_CTE = (
    f"st AS (SELECT *, {STAGE_SQL} AS stage, {WEIGHT_SQL} AS weight FROM alerts), "
    "en AS (SELECT 'host' AS bucket, lower(host) AS entity, * FROM st WHERE host <> '' UNION ALL "
    "SELECT 'user', lower(\"user\"), * FROM st WHERE \"user\" <> '' UNION ALL SELECT 'ip', ip, * FROM st WHERE ip <> ''), "
    "fw AS (SELECT *, min(alert_ts) OVER (PARTITION BY bucket, entity) AS first_ts FROM en), "
    "mem AS (SELECT * FROM fw WHERE alert_ts <= first_ts + INTERVAL 60 MINUTE)"
)


def _seen(column: str) -> str:
    return (
        f"array_to_string((SELECT list(v ORDER BY t, i) FROM (SELECT m2.{column} AS v, min(m2.alert_ts) AS t, "
        f"arg_min(m2.alert_id, (m2.alert_ts, m2.alert_id)) AS i FROM mem m2 WHERE m2.bucket = g.bucket AND m2.entity = g.entity "
        f"AND m2.{column} <> '' GROUP BY 1)), '; ')"
    )


INC_ISO = (
    "CASE WHEN microsecond(created_at) % 1000000 = 0 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') END"
)
INCIDENTS_CTE = ENTITIES_CTE + (
    ", g AS (SELECT bucket, entity, min(alert_ts) AS created_at, count(*) AS alert_count, "
    "least(100, sum(weight) + least(25, 5 * count(DISTINCT stage))) AS risk_score FROM mem GROUP BY 1, 2 HAVING count(*) >= 2), "
    f"inc AS (SELECT substr(sha256(bucket || ':' || entity || ':' || {INC_ISO}), 1, 16) AS incident_id, "
    "'Correlated ' || upper(bucket[1]) || bucket[2:] || ' Incident: ' || entity AS title, * FROM g)"
)


@register(
    "alert_context",
    over_alerts("SELECT alert_id, host, \"user\" AS username, ip FROM alerts"),
)
def alert_context(spark, sf_dir):
    return co.alert_context(alerts(spark, sf_dir)).select("alert_id", "host", F.col("user").alias("username"), "ip")


@register(
    "entity_alerts",
    over_alerts("SELECT bucket, entity, alert_id, stage, CAST(weight AS BIGINT) AS weight FROM en", ENTITIES_CTE),
)
def entity_alerts(spark, sf_dir):
    return co.entity_alerts(alerts(spark, sf_dir)).select(
        "bucket", "entity", "alert_id", "stage", F.col("weight").cast("bigint").alias("weight")
    )


@register("incident_members", over_alerts("SELECT bucket, entity, alert_id FROM mem", ENTITIES_CTE))
def incident_members(spark, sf_dir):
    return co.incident_alerts(alerts(spark, sf_dir)).select("bucket", "entity", "alert_id")


@register(
    "incidents",
    over_alerts(
        "SELECT incident_id, title, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, alert_count, "
        f"CAST(risk_score AS BIGINT) AS risk_score, {_seen('stage')} AS stages, {_seen('mitre_tactic')} AS tactics, "
        f"{_seen('mitre_technique')} AS techniques FROM inc g",
        INCIDENTS_CTE,
    ),
)
def incidents(spark, sf_dir):
    return co.correlate_alerts(alerts(spark, sf_dir)).select(
        "incident_id", "title", ts_text("created_at").alias("created"), "alert_count",
        F.col("risk_score").cast("bigint").alias("risk_score"), F.array_join("stages", "; ").alias("stages"),
        F.array_join("mitre_tactics", "; ").alias("tactics"), F.array_join("mitre_techniques", "; ").alias("techniques"),
    )


@register(
    "forensic_incidents",
    over_alerts(
        "SELECT title, CAST(risk_score AS BIGINT) AS risk_score, alert_count FROM inc ORDER BY risk_score DESC, created_at DESC, incident_id LIMIT 10",
        INCIDENTS_CTE,
    ),
)
def forensic_incidents(spark, sf_dir):
    found = alerts(spark, sf_dir)
    return reports.forensic_tables(found, co.correlate_alerts(found))["incidents"].withColumn(
        "risk_score", F.col("risk_score").cast("bigint")
    )


@register(
    "forensic_alerts",
    over_alerts(
        "SELECT strftime(alert_ts, '%Y-%m-%d %H:%M:%S') AS alert_time, upper(severity) AS severity, rule_name, "
        "mitre_tactic || ' / ' || mitre_technique AS labels FROM alerts ORDER BY alert_ts, alert_id LIMIT 20"
    ),
)
def forensic_alerts(spark, sf_dir):
    found = alerts(spark, sf_dir)
    return reports.forensic_tables(found, co.correlate_alerts(found))["alert_timeline"]


# ---- payloads --------------------------------------------------------------------------


def _fields(df: DataFrame, **paths: str) -> DataFrame:
    return df.select("alert_id", *[F.get_json_object("value", p).alias(n) for n, p in paths.items()])


@register(
    "json_report",
    over_alerts(
        "SELECT alert_id, rule_name, severity, strftime(alert_ts, '%Y-%m-%d %H:%M:%S') AS alert_time, CAST(n AS VARCHAR) AS evidence_count, "
        "CAST(n > CASE WHEN rule_name = 'Attack Chain Detected' THEN 15 ELSE 10 END AS VARCHAR) AS truncated FROM alerts"
    ),
)
def json_report(spark, sf_dir):
    return _fields(
        payloads.report_rows(alerts(spark, sf_dir)), rule_name="$.rule_name", severity="$.severity",
        alert_time="$.timestamp", evidence_count="$.evidence_count", truncated="$.evidence_truncated",
    )


@register(
    "csv_report",
    over_alerts(
        "SELECT strftime(alert_ts, '%Y-%m-%d %H:%M:%S') AS \"Timestamp\", severity AS \"Severity\", rule_name AS \"Rule\", "
        "description AS \"Description\", mitre_tactic AS \"MITRE Tactic\", mitre_technique AS \"MITRE Technique\", CAST(n AS BIGINT) AS \"Evidence Count\" FROM alerts"
    ),
)
def csv_report(spark, sf_dir):
    return payloads.csv_rows(alerts(spark, sf_dir)).drop("Recommendation")


@register(
    "collector_payload",
    over_alerts(
        "SELECT alert_id, CAST(epoch_us(alert_ts) AS BIGINT) AS time_us, 'main' AS idx, rule_name, CAST(n AS VARCHAR) AS evidence_count FROM alerts"
    ),
)
def collector_payload(spark, sf_dir):
    rows = payloads.collector_rows(alerts(spark, sf_dir), 0)
    return _fields(
        rows, time="$.time", idx="$.index", rule_name="$.event.rule_name", evidence_count="$.event.evidence_count"
    ).select(
        "alert_id", F.round(F.col("time").cast("double") * 1_000_000).cast("bigint").alias("time_us"), "idx", "rule_name", "evidence_count"
    )


@register(
    "bulk_payload",
    over_alerts(
        "SELECT alert_id, 0::BIGINT AS line_no, 'soc-alerts' AS idx, NULL AS at, NULL AS rule_name FROM alerts UNION ALL "
        "SELECT alert_id, 1, NULL, iso, rule_name FROM alerts"
    ),
)
def bulk_payload(spark, sf_dir):
    rows = payloads.bulk_rows(alerts(spark, sf_dir), 0, "soc-alerts")
    return rows.select(
        "alert_id", F.col("line_no").cast("bigint").alias("line_no"), F.get_json_object("value", "$.index._index").alias("idx"),
        F.get_json_object("value", "$['@timestamp']").alias("at"), F.get_json_object("value", "$.rule_name").alias("rule_name"),
    )


@register(
    "custom_event_payload",
    over_alerts(
        "SELECT alert_id, iso AS at, CASE severity WHEN 'low' THEN '3' WHEN 'medium' THEN '7' WHEN 'high' THEN '12' "
        "WHEN 'critical' THEN '15' ELSE '5' END AS level, mitre_tactic AS tactic, rule_name FROM alerts"
    ),
)
def custom_event_payload(spark, sf_dir):
    return _fields(
        payloads.custom_event_rows(alerts(spark, sf_dir), 0), at="$.timestamp", level="$.rule.level",
        tactic="$.rule.groups[1]", rule_name="$.data.rule_name",
    )


_SEED = "rule_name || '|' || iso || '|' || mitre_technique || '|' || substr(sha256(description), 1, 16)"


def _uuid(seed: str) -> str:
    d = f"sha1(from_hex('{payloads.NAMESPACE.hex}') || encode({seed}))"
    variant = f"['8','9','a','b'][(instr('0123456789abcdef', substr({d}, 17, 1)) - 1) % 4 + 1]"
    return (
        f"substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-5' || substr({d}, 14, 3) || '-' || {variant} || "
        f"substr({d}, 18, 3) || '-' || substr({d}, 21, 12)"
    )


@register(
    "intel_indicators",
    over_alerts(
        f"SELECT alert_id, 'indicator--' || {_uuid(_SEED)} AS id, rule_name AS name, CASE severity WHEN 'low' THEN '25' "
        "WHEN 'medium' THEN '50' WHEN 'high' THEN '75' ELSE '95' END AS confidence, iso || 'Z' AS valid_from, "
        "split_part(mitre_technique, ' ', 1) AS external_id, replace(lower(mitre_tactic), ' ', '-') AS tactic_label FROM alerts"
    ),
)
def intel_indicators(spark, sf_dir):
    rows = payloads.intel_objects(alerts(spark, sf_dir)).where(F.col("kind") == "indicator")
    return rows.select(
        "alert_id", "id", F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.confidence").alias("confidence"),
        F.get_json_object("value", "$.valid_from").alias("valid_from"),
        F.get_json_object("value", "$.external_references[0].external_id").alias("external_id"),
        F.get_json_object("value", "$.labels[2]").alias("tactic_label"),
    )


@register(
    "intel_sightings",
    over_alerts(
        f"SELECT alert_id, 'sighting--' || {_uuid(_SEED + chr(32) + '|| ' + repr('|sighting'))} AS id, CAST(n AS VARCHAR) AS count, "
        f"'indicator--' || {_uuid(_SEED)} AS sighting_of_ref FROM alerts"
    ),
)
def intel_sightings(spark, sf_dir):
    rows = payloads.intel_objects(alerts(spark, sf_dir)).where(F.col("kind") == "sighting")
    return rows.select(
        "alert_id", "id", F.get_json_object("value", "$.count").alias("count"),
        F.get_json_object("value", "$.sighting_of_ref").alias("sighting_of_ref"),
    )


@register(
    "store_mitre_mappings",
    over_alerts("SELECT mitre_tactic AS tactic, mitre_technique AS technique, count(*) AS n FROM alerts GROUP BY 1, 2"),
)
def store_mitre_mappings(spark, sf_dir):
    folder = store.scratch_path(spark, "store")
    store.save_alerts(alerts(spark, sf_dir), folder)
    rows = spark.read.parquet(f"{folder}/mitre_mappings")
    return rows.groupBy("tactic", "technique").agg(F.count(F.lit(1)).alias("n"))


@register(
    "store_first_alerts",
    over_alerts(
        "SELECT strftime(alert_ts, '%Y-%m-%d %H:%M:%S') AS alert_time, rule_name FROM alerts "
        "ORDER BY strftime(alert_ts, '%Y-%m-%d %H:%M:%S'), alert_id LIMIT 25"
    ),
)
def store_first_alerts(spark, sf_dir):
    folder = store.scratch_path(spark, "store")
    store.save_alerts(alerts(spark, sf_dir), folder)
    rows = store.scan_table(spark, f"{folder}/alerts", ["alert_ts", "alert_id"], limit=25)
    return rows.select(ts_text("alert_ts").alias("alert_time"), "rule_name")


@register(
    "severity_summary_after_hours",
    over_alerts(
        "SELECT s.severity, count(a.severity) AS n FROM (VALUES ('info'), ('low'), ('medium'), ('high'), ('critical')) "
        "AS s(severity) LEFT JOIN alerts a ON a.severity = s.severity AND a.rule_name = 'After-Hours Logon' GROUP BY 1"
    ),
)
def severity_summary_after_hours(spark, sf_dir):
    rules = [r for r in stateless_rules(SETTINGS, ["initial_access"]) if isinstance(r.rule_name, str) and r.rule_name == "After-Hours Logon"]
    return reports.severity_summary(run_row_rules(sec_events(spark, sf_dir), rules))
