"""Summary tables over alerts and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import technique_ids
from emberwatch.operators.correlate import rank_incidents
from emberwatch.schema import SEVERITIES, epoch_micros, ts_text

# Tactics in the order of the coverage matrix.
TACTICS = [
    "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion",
    "Credential Access", "Discovery", "Lateral Movement", "Collection", "Exfiltration",
    "Command and Control", "Impact",
]


def _count() -> Column:
    return F.count(F.lit(1))


def severity_summary(alerts: DataFrame) -> DataFrame:
    """Count per severity, all five levels, zeros included. One aggregate, no join."""
    counts = alerts.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def top_rules(alerts: DataFrame, limit: int = 5) -> DataFrame:
    """Most frequent rules; among equals the one seen first."""
    return (
        alerts.groupBy("rule_name").agg(_count().alias("n"), F.min("alert_ts").alias("first_ts"))
        .orderBy(F.col("n").desc(), "first_ts", "rule_name").limit(limit)
    )


def tactic_matrix(alerts: DataFrame) -> DataFrame:
    """Counts per tactic and technique with the tactic's total and the largest cell."""
    cells = (
        alerts.where(F.col("mitre_tactic").isin(TACTICS) & (F.col("mitre_technique") != ""))
        .groupBy("mitre_tactic", "mitre_technique").agg(_count().alias("n"))
    )
    labelled = alerts.where((F.col("mitre_tactic") != "") & (F.col("mitre_technique") != ""))
    largest = (
        labelled.groupBy("mitre_tactic", "mitre_technique").agg(_count().alias("n")).agg(F.max("n")).scalar()
    )
    totals = cells.groupBy("mitre_tactic").agg(F.sum("n").alias("tactic_total"))
    return cells.join(totals, "mitre_tactic").withColumn("largest", largest)


def tactic_spread(alerts: DataFrame) -> DataFrame:
    tactic = F.when(F.col("mitre_tactic") == "", "Uncategorized").otherwise(F.col("mitre_tactic"))
    return alerts.groupBy(tactic.alias("tactic")).agg(_count().alias("n"))


def label_ranking(alerts: DataFrame, limit: int = 20) -> DataFrame:
    """Tactics and techniques in one ranking; equals in alphabetical order."""
    return (
        alerts.select(F.explode(F.array("mitre_tactic", "mitre_technique")).alias("label"))
        .where(F.col("label") != "")
        .groupBy("label").agg(_count().alias("n"))
        .orderBy(F.col("n").desc(), "label").limit(limit)
    )


def technique_layer(alerts: DataFrame) -> DataFrame:
    """Per technique id: score, rules, severities, comment and the largest score."""
    hits = alerts.select(
        F.explode(technique_ids("mitre_technique", "mitre_tactic")).alias("technique_id"), "rule_name", "severity"
    )
    # Lists are of rule names and severities, as many as are defined, not as alerts exist.
    layer = (
        hits.groupBy("technique_id", "rule_name", "severity").agg(_count().alias("n"))
        .groupBy("technique_id")
        .agg(
            F.sum("n").alias("score"),
            F.array_sort(F.collect_set("rule_name")).alias("rules"),
            F.array_sort(F.collect_set("severity")).alias("severities"),
        )
    )
    comment = F.concat(
        F.col("score").cast("string"), F.lit(" alert(s) across "), F.size("rules").cast("string"), F.lit(" rule(s): "),
        F.array_join(F.slice("rules", 1, 5), ", "), F.when(F.size("rules") > 5, " ...").otherwise(""),
        F.lit(". Severities: "), F.array_join("severities", ", "), F.lit("."),
    )
    return layer.select(
        "technique_id", "score", comment.alias("comment"),
        F.array_join(F.slice("rules", 1, 10), ", ").alias("rules"),
        F.col("technique_id").contains(".").alias("is_subtechnique"),
        layer.agg(F.max("score")).scalar().alias("max_score"),
    )


def _bounds(alerts: DataFrame) -> tuple[Column, Column]:
    """First alert time in microseconds and span (60 s when there is none), as scalar subqueries."""
    micros = epoch_micros("alert_ts")
    first = alerts.agg(F.min(micros)).scalar()
    span = alerts.agg(F.max(micros) - F.min(micros)).scalar()
    return first, F.when(span == 0, 60_000_000).otherwise(span)


def timeline(alerts: DataFrame) -> DataFrame:
    """Alerts with their offset from the first alert and their place on the time axis."""
    first, span = _bounds(alerts)
    offset = epoch_micros("alert_ts") - first
    return alerts.select(
        "alert_id", "rule_name", "severity", "alert_ts",
        (offset / 1_000_000).alias("offset_seconds"), (offset / span).alias("fraction"),
    )


def timeline_ticks(alerts: DataFrame) -> DataFrame:
    """Tick marks of the time axis: between 3 and 8 intervals."""
    first, span = _bounds(alerts)
    return (
        alerts.agg(F.least(F.lit(8), F.greatest(F.lit(3), _count())).cast("int").alias("intervals"))
        .select("intervals", F.explode(F.sequence(F.lit(0), F.col("intervals"))).alias("tick"))
        .select(
            "tick", (F.col("tick") / F.col("intervals")).alias("fraction"),
            (first + F.col("tick") / F.col("intervals") * span).cast("bigint").alias("tick_micros"),
        )
    )


def detection_rate(files: DataFrame, alert_counts: DataFrame) -> DataFrame:
    """Per first directory: files, files with alerts, rate in percent, alerts.

    ``files`` has ``src_file`` (path below the corpus root), ``alert_counts`` has
    ``src_file`` and ``n_alerts``.
    """
    parts = F.split("src_file", "/")
    directory = F.when(F.size(parts) >= 2, parts[0]).otherwise("uncategorized")
    counts = alert_counts.groupBy("src_file").agg(F.sum("n_alerts").alias("n_alerts"))
    n = F.coalesce(F.col("n_alerts"), F.lit(0))
    return (
        files.select("src_file").distinct().join(counts, "src_file", "left")
        .groupBy(directory.alias("directory"))
        .agg(_count().alias("files"), F.count_if(n > 0).alias("files_with_alerts"), F.sum(n).alias("alerts"))
        .withColumn("rate", F.bround(F.col("files_with_alerts") * 100 / F.col("files"), 0).cast("bigint"))
    )


def detector_profile(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("detector").agg(_count().alias("n"))


def forensic_tables(alerts: DataFrame, incidents: DataFrame) -> dict[str, DataFrame]:
    """The tables of the forensic report. Alerts are listed in store order (time, id)."""
    ordered = alerts.orderBy("alert_ts", "alert_id")
    return {
        "summary": severity_summary(alerts),
        "incidents": rank_incidents(incidents).select("title", "risk_score", "alert_count").limit(10),
        "labels": label_ranking(alerts),
        "alert_timeline": ordered.limit(20).select(
            ts_text("alert_ts").alias("alert_time"), F.upper("severity").alias("severity"), "rule_name",
            F.concat_ws(" / ", "mitre_tactic", "mitre_technique").alias("labels"),
        ),
        "evidence_counts": ordered.limit(10).select(
            ts_text("alert_ts").alias("alert_time"), "rule_name", "evidence_count"
        ),
    }
