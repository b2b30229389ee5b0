"""Alerts to incidents: alerts of one host, user or IP within an hour of its first alert.

An entity may own any share of the alerts, so its alerts are never listed in one row:
incidents carry counts, scores and the distinct stages and labels, and membership is a
table of its own (:func:`incident_alerts`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import first_match
from emberwatch.operators.windows import prefix_window
from emberwatch.schema import ts_iso

# Ordered keywords and the stage each stands for.
STAGE_KEYWORDS = {
    "powershell": "PowerShell Execution",
    "encodedcommand": "Encoded Command",
    "-enc": "Encoded Command",
    "downloadstring": "Network Connection",
    "downloadfile": "Network Connection",
    "curl": "Network Connection",
    "wget": "Network Connection",
    "schtasks": "Persistence Event",
    "service": "Persistence Event",
    "psexec": "Lateral Movement",
}

# Risk weights, stage bonus and bounds.
SEVERITY_WEIGHTS = {"low": 10, "medium": 20, "high": 35, "critical": 50}
STAGE_BONUS, STAGE_BONUS_CAP, SCORE_CAP = 5, 25, 100


def alert_stage() -> Column:
    """First keyword in rule, description and technique; else the technique; else general."""
    text = F.lower(F.concat_ws(" ", "rule_name", "description", "mitre_technique"))
    cases = [(text.contains(word), stage) for word, stage in STAGE_KEYWORDS.items()]
    fallback = F.when(F.col("mitre_technique") != "", F.col("mitre_technique")).otherwise("General Alert")
    return first_match(cases, fallback)


def first_evidence(*fields: str) -> Column:
    """First non-empty value over the evidence rows; within a row the fields are tried in order."""

    def pick(e: Column) -> Column:
        return F.coalesce(*[F.nullif(e[f], F.lit("")) for f in fields])

    return F.coalesce(F.get(F.array_compact(F.transform("evidence", pick)), F.lit(0)), F.lit(""))


def alert_context(alerts: DataFrame) -> DataFrame:
    """Alerts with host, user and ip."""
    return alerts.withColumns(
        {
            "host": first_evidence("computer"),
            "user": first_evidence("username", "target_username"),
            "ip": first_evidence("source_ip"),
        }
    )


def entity_alerts(alerts: DataFrame) -> DataFrame:
    """One row per alert and entity it belongs to, with the columns correlation needs."""
    entities = F.array(
        F.struct(F.lit("host").alias("bucket"), F.lower("host").alias("entity")),
        F.struct(F.lit("user").alias("bucket"), F.lower("user").alias("entity")),
        F.struct(F.lit("ip").alias("bucket"), F.col("ip").alias("entity")),
    )
    weight = first_match([(F.col("severity") == s, w) for s, w in SEVERITY_WEIGHTS.items()], 0)
    return (
        alert_context(alerts)
        .select(
            "alert_id", "alert_ts", "rule_name", "severity", "mitre_tactic", "mitre_technique",
            alert_stage().alias("stage"), weight.alias("weight"),
            F.explode(F.filter(entities, lambda x: x["entity"] != "")).alias("e"),
        )
        .select("e.bucket", "e.entity", "*")
        .drop("e")
    )


def incident_alerts(alerts: DataFrame, window_minutes: int = 60) -> DataFrame:
    """Members of possible incidents: alerts near the first alert of their entity."""
    rows = entity_alerts(alerts)
    return prefix_window(rows, ["bucket", "entity"], "alert_ts", window_minutes * 60)


def _first_seen(kind: str) -> Column:
    """Distinct values of one kind in order of their first alert."""
    picked = F.filter("seen", lambda x: x["kind"] == kind)
    return F.transform(picked, lambda x: x["value"])


def correlate_alerts(alerts: DataFrame, window_minutes: int = 60, min_alerts: int = 2) -> DataFrame:
    """Incidents, not ordered; see :func:`rank_incidents`."""
    keys = ["bucket", "entity"]
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"))
          for k, c in (("stage", "stage"), ("tactic", "mitre_tactic"), ("technique", "mitre_technique"))]
    )
    # First step: one row per (entity, label), combined map-side. The second step then lists
    # labels, of which there are as many as the rules define, not as there are alerts.
    labels = (
        incident_alerts(alerts, window_minutes)
        .select(*keys, "first_ts", "alert_ts", "alert_id", "weight", F.explode(kinds).alias("k"))
        .groupBy(*keys, "k.kind", "k.value")
        .agg(
            F.min("first_ts").alias("first_ts"),
            F.min(F.struct("alert_ts", "alert_id")).alias("at"),
            F.count(F.lit(1)).alias("n"),
            F.sum("weight").alias("weight"),
        )
    )
    is_stage = F.col("kind") == "stage"
    groups = labels.groupBy(*keys).agg(
        F.min("first_ts").alias("created_at"),
        F.sum(F.when(is_stage, F.col("n"))).alias("alert_count"),
        F.sum(F.when(is_stage, F.col("weight"))).alias("weight"),
        F.array_sort(F.collect_list(F.when(F.col("value") != "", F.struct("at", "kind", "value")))).alias("seen"),
    ).where(F.col("alert_count") >= min_alerts)
    out = groups.select(
        *keys, "created_at", "alert_count", "weight",
        _first_seen("stage").alias("stages"),
        _first_seen("tactic").alias("mitre_tactics"),
        _first_seen("technique").alias("mitre_techniques"),
    )
    score = F.least(
        F.lit(SCORE_CAP), F.col("weight") + F.least(F.lit(STAGE_BONUS_CAP), F.size("stages") * STAGE_BONUS)
    )

    def only(bucket: str) -> Column:
        return F.when(F.col("bucket") == bucket, F.col("entity")).otherwise("")

    return out.select(
        F.substring(F.sha2(F.concat_ws(":", "bucket", "entity", ts_iso("created_at")), 256), 1, 16).alias("incident_id"),
        F.concat(
            F.lit("Correlated "), F.initcap("bucket"), F.lit(" Incident: "), F.col("entity")
        ).alias("title"),
        "created_at", "bucket", "entity",
        only("host").alias("host"), only("user").alias("user"), only("ip").alias("ip"),
        score.cast("int").alias("risk_score"), "alert_count", "stages", "mitre_tactics", "mitre_techniques",
    )


def rank_incidents(incidents: DataFrame) -> DataFrame:
    """Highest risk first, then latest."""
    return incidents.orderBy(F.col("risk_score").desc(), F.col("created_at").desc(), "incident_id")
