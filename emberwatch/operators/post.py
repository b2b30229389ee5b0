"""Operators on alerts: severity filter, facets, allowlist, ranking, de-duplication."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import first_match
from emberwatch.operators.alerts import watch_token
from emberwatch.schema import SEVERITIES, ts_text


def at_least(alerts: DataFrame, severity: str) -> DataFrame:
    return alerts.where(F.col("severity_rank") >= SEVERITIES.index(severity))


def any_at_least(alerts: DataFrame, severity: str) -> DataFrame:
    """One row: does any alert reach the severity?"""
    top = F.coalesce(F.max("severity_rank"), F.lit(-1))
    return alerts.agg((top >= SEVERITIES.index(severity)).alias("actionable"))


def facet_filter(alerts: DataFrame, severities=None, tactics=None, rules=None, hosts=None) -> DataFrame:
    """Alerts in the chosen facets. Alerts without a tactic or without evidence hosts pass those two."""
    out = alerts
    if severities is not None:
        out = out.where(F.col("severity").isin(list(severities)))
    if tactics is not None:
        out = out.where((F.col("mitre_tactic") == "") | F.col("mitre_tactic").isin(list(tactics)))
    if rules is not None:
        out = out.where(F.col("rule_name").isin(list(rules)))
    if hosts:
        # Evidence rows without a host put a NULL in the list: then the alert has hosts but no overlap.
        listed = F.transform("evidence", lambda e: e["computer"])
        chosen = F.array(*[F.lit(h) for h in hosts])
        out = out.where((F.size(listed) == 0) | F.coalesce(F.arrays_overlap(listed, chosen), F.lit(False)))
    return out


def _in_evidence(field: str, value: str) -> Column:
    """The value is in an alert's evidence, shown or (through ``watch_hits``) not shown."""
    low = field in ("username", "computer")
    wanted = value.lower() if low else value

    def same(e: Column) -> Column:
        text = F.coalesce(e[field].cast("string"), F.lit(""))
        return (F.lower(text) if low else text) == wanted

    return F.exists("evidence", same) | F.array_contains("watch_hits", F.lit(watch_token(field, wanted)))


def allowlist_reason(allowlist: Iterable[Mapping]) -> Column:
    """Reason of the first allowlist entry an alert matches, NULL for none.

    Entries come from configuration, so they become one CASE expression: no join.
    """
    cases = []
    for entry in allowlist:
        test = F.lit(True)
        if "rule_name" in entry:
            test = test & F.lower("rule_name").contains(str(entry["rule_name"]).lower())
        if "severity" in entry:
            test = test & (F.col("severity") == str(entry["severity"]).lower())
        if "mitre_technique" in entry:
            test = test & F.upper("mitre_technique").contains(str(entry["mitre_technique"]).upper())
        for field in ("username", "computer", "source_ip", "event_id"):
            if field in entry:
                test = test & _in_evidence(field, str(entry[field]))
        reason = entry.get("reason", "allowlisted")
        cases.append((test, F.lit("allowlisted" if reason is None else str(reason))))
    return first_match(cases, F.lit(None).cast("string")) if cases else F.lit(None).cast("string")


def apply_allowlist(alerts: DataFrame, allowlist: Iterable[Mapping]) -> tuple[DataFrame, DataFrame]:
    """(kept alerts, suppressed alerts with ``reason``)."""
    marked = alerts.withColumn("reason", allowlist_reason(allowlist))
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def suppression_stats(suppressed: DataFrame) -> DataFrame:
    return suppressed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def rank_alerts(alerts: DataFrame) -> DataFrame:
    """Most severe first, then by time."""
    return alerts.orderBy(F.col("severity_rank").desc(), "alert_ts", "alert_id")


def dedup_alerts(alerts: DataFrame) -> DataFrame:
    """One alert per rule and second: the first by time and id.

    ``min_by`` keeps one row per group map-side, so repeated alerts never meet in one task.
    """
    row = F.struct(*alerts.columns)
    return (
        alerts.groupBy(F.col("rule_name").alias("_rule"), ts_text("alert_ts").alias("_second"))
        .agg(F.min_by(row, F.struct("alert_ts", "alert_id")).alias("row"))
        .select("row.*")
    )
