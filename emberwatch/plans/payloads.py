"""Rows in the shape other systems take: JSON and CSV reports, SIEM, search and threat-intel payloads.

Only the payload tables are built; sending them is left to the caller.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.events import severity_level
from emberwatch.functions.text import first_match
from emberwatch.plans.reports import severity_summary
from emberwatch.schema import computed_once, epoch_micros, ts_iso, ts_text

TOOL = "emberwatch"

# Confidence per severity.
CONFIDENCE = {"low": 25, "medium": 50, "high": 75, "critical": 95}
OTHER_CONFIDENCE = 50

# Our own namespace for name-based ids.
NAMESPACE = uuid.UUID("5b1c2f0e-7a64-4d1e-9a53-1f6f2c7e8d90")


def _alert_fields() -> list[Column]:
    return [
        F.col("rule_name"), F.col("severity"), F.col("description"), F.col("mitre_tactic"), F.col("mitre_technique"),
        F.col("recommendation"), F.col("evidence_count"), F.col("evidence"),
    ]


def report_rows(alerts: DataFrame) -> DataFrame:
    """One JSON document per alert of the JSON report."""
    doc = F.struct(
        "rule_name", "severity", "description", ts_text("alert_ts").alias("timestamp"), "mitre_tactic",
        "mitre_technique", "recommendation", "evidence_count", "evidence", "evidence_truncated",
    )
    return alerts.select("alert_id", F.to_json(doc).alias("value"))


def report_metadata(alerts: DataFrame, total_events: int) -> DataFrame:
    """One row with the report's head: totals and the severity summary."""
    return severity_summary(alerts).agg(
        F.lit(TOOL).alias("tool"),
        F.lit(total_events).cast("bigint").alias("total_events_analyzed"),
        F.sum("n").alias("total_alerts"),
        F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("severity_summary"),
    )


def write_json_report(alerts: DataFrame, total_events: int, folder: str) -> None:
    report_metadata(alerts, total_events).write.mode("overwrite").json(f"{folder}/metadata")
    report_rows(alerts).select("value").write.mode("overwrite").text(f"{folder}/alerts")


def csv_rows(alerts: DataFrame) -> DataFrame:
    """The eight columns of the CSV report."""
    return alerts.select(
        ts_text("alert_ts").alias("Timestamp"), F.col("severity").alias("Severity"), F.col("rule_name").alias("Rule"),
        F.col("description").alias("Description"), F.col("mitre_tactic").alias("MITRE Tactic"),
        F.col("mitre_technique").alias("MITRE Technique"), F.col("recommendation").alias("Recommendation"),
        F.col("evidence_count").alias("Evidence Count"),
    )


def write_csv_report(alerts: DataFrame, total_events: int, folder: str) -> None:
    """CSV part files plus the totals next to them (a comment line inside would break CSV readers)."""
    csv_rows(alerts).write.mode("overwrite").option("header", True).csv(f"{folder}/alerts")
    report_metadata(alerts, total_events).write.mode("overwrite").json(f"{folder}/metadata")


def collector_rows(alerts: DataFrame, total_events: int, index: str = "main", sourcetype: str = f"{TOOL}:alert",
                   host: str = TOOL, source: str = TOOL) -> DataFrame:
    """HTTP event collector envelopes, one JSON line per alert."""
    event = F.struct(
        *_alert_fields(), F.lit(total_events).cast("bigint").alias("total_events_analyzed"),
        F.unix_timestamp(F.current_timestamp()).alias("ingested_at"), F.lit(TOOL).alias("tool"),
    )
    envelope = F.struct(
        (epoch_micros("alert_ts") / 1_000_000).alias("time"), F.lit(host).alias("host"), F.lit(source).alias("source"),
        F.lit(sourcetype).alias("sourcetype"), F.lit(index).alias("index"), event.alias("event"),
    )
    return alerts.select("alert_id", F.to_json(envelope).alias("value"))


def bulk_rows(alerts: DataFrame, total_events: int, index: str = f"{TOOL}-alerts") -> DataFrame:
    """Bulk-index lines: an action line and a document line per alert, adjacent and in order."""
    doc = F.struct(
        ts_iso("alert_ts").alias("@timestamp"), *_alert_fields(),
        F.lit(total_events).cast("bigint").alias("total_events_analyzed"), F.lit(TOOL).alias("tool"),
        ts_iso(F.current_timestamp().cast("timestamp_ntz")).alias("ingested_at"),
    )
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index")).alias("index")))
    return alerts.select("alert_id", F.posexplode(F.array(action, F.to_json(doc))).alias("line_no", "value"))


def custom_event_rows(alerts: DataFrame, total_events: int) -> DataFrame:
    """SIEM custom events, one JSON line per alert. The rule number is a checksum of its name."""
    rule_id = F.concat(F.lit(f"{TOOL}-"), (F.crc32(F.encode("rule_name", "UTF-8")) % 100000).cast("string"))
    tactic = F.when(F.col("mitre_tactic") == "", "uncategorized").otherwise(F.col("mitre_tactic"))
    payload = F.struct(
        ts_iso("alert_ts").alias("timestamp"),
        F.struct(
            severity_level("severity").alias("level"), F.col("description"), rule_id.alias("id"),
            F.array(F.lit(TOOL), tactic).alias("groups"),
        ).alias("rule"),
        F.struct(F.lit(TOOL).alias("name"), F.lit("000").alias("id")).alias("agent"),
        F.struct(
            "rule_name", "severity", "mitre_tactic", "mitre_technique", "recommendation", "evidence_count", "evidence",
            F.lit(total_events).cast("bigint").alias("total_events_analyzed"),
        ).alias("data"),
        ts_iso(F.current_timestamp().cast("timestamp_ntz")).alias("@timestamp"),
    )
    return alerts.select("alert_id", F.to_json(payload).alias("value"))


def name_uuid(seed: Column) -> Column:
    """Version-5 UUID text of ``seed`` in :data:`NAMESPACE`. The digest is bound to a name, so it is made once."""

    def text(digest: Column) -> Column:
        variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
        return F.concat_ws(
            "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
            F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
        )

    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(seed, "UTF-8")))
    return F.get(F.transform(F.array(digest), text), F.lit(0))


def indicator_pattern() -> Column:
    """Pattern text from the first evidence row of an alert."""
    first = F.get("evidence", F.lit(0))
    user = F.coalesce(F.nullif(first["username"], F.lit("")), F.nullif(first["target_username"], F.lit("")))
    terms = F.array_compact(
        F.array(
            *[
                F.concat(F.lit(f"{name} = '"), F.nullif(value, F.lit("")), F.lit("'"))
                for name, value in (
                    ("ipv4-addr:value", first["source_ip"]),
                    ("user-account:account_login", user),
                    ("hostname:value", first["computer"]),
                )
            ]
        )
    )
    by_rule = F.concat(F.lit(f"x-{TOOL}:rule = '"), F.col("rule_name"), F.lit("'"))
    body = F.when(F.size(terms) > 0, F.array_join(terms, " AND ")).otherwise(by_rule)
    return F.concat(F.lit("["), body, F.lit("]"))


def intel_objects(alerts: DataFrame, creator: str = TOOL) -> DataFrame:
    """An indicator and a sighting per alert (``kind``, ``id``, ``value`` as JSON). Ids repeat on re-runs."""
    seed = F.concat_ws(
        "|", "rule_name", ts_iso("alert_ts"), "mitre_technique", F.substring(F.sha2("description", 256), 1, 16)
    )
    # The objects name the ids several times; they are made once per alert.
    alerts = computed_once(alerts, _seed=seed)
    alerts = computed_once(alerts, _indicator=name_uuid(F.col("_seed")), _sighting=name_uuid(F.concat("_seed", F.lit("|sighting"))))
    indicator_id, sighting_id = F.concat(F.lit("indicator--"), "_indicator"), F.concat(F.lit("sighting--"), "_sighting")
    author = f"identity--{uuid.uuid5(NAMESPACE, creator)}"
    seen = F.concat(ts_iso("alert_ts"), F.lit("Z"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.000'Z'")
    confidence = first_match([(F.col("severity") == s, c) for s, c in CONFIDENCE.items()], OTHER_CONFIDENCE)
    labels = F.array_compact(
        F.array(
            F.col("severity"), F.lit(TOOL),
            F.nullif(F.replace(F.lower("mitre_tactic"), F.lit(" "), F.lit("-")), F.lit("")),
        )
    )
    references = F.when(
        F.col("mitre_technique") != "",
        F.array(
            F.struct(
                F.lit("mitre-attack").alias("source_name"),
                F.substring_index("mitre_technique", " ", 1).alias("external_id"),
                F.col("mitre_technique").alias("description"),
            )
        ),
    )
    head = [F.lit("2.1").alias("spec_version"), F.lit(author).alias("created_by_ref"), now.alias("created"), now.alias("modified")]
    indicator = F.to_json(
        F.struct(
            F.lit("indicator").alias("type"), indicator_id.alias("id"), *head, F.col("rule_name").alias("name"),
            "description", F.array(F.lit("malicious-activity")).alias("indicator_types"),
            indicator_pattern().alias("pattern"), F.lit("stix").alias("pattern_type"),
            F.lit("2.1").alias("pattern_version"), seen.alias("valid_from"), confidence.alias("confidence"),
            labels.alias("labels"), references.alias("external_references"),
        )
    )
    sighting = F.to_json(
        F.struct(
            F.lit("sighting").alias("type"), sighting_id.alias("id"), *head, seen.alias("first_seen"),
            seen.alias("last_seen"), F.greatest(F.col("evidence_count"), F.lit(1)).alias("count"),
            indicator_id.alias("sighting_of_ref"),
            F.when(F.col("recommendation") != "", F.col("recommendation")).otherwise(F.col("description")).alias("description"),
        )
    )
    # One row per kind first: an object is built for the kinds that are asked for only.
    kinds = alerts.select("*", F.explode(F.array(F.lit("indicator"), F.lit("sighting"))).alias("kind"))
    is_indicator = F.col("kind") == "indicator"
    return kinds.select(
        "alert_id", "kind", F.when(is_indicator, indicator_id).otherwise(sighting_id).alias("id"),
        F.when(is_indicator, indicator).otherwise(sighting).alias("value"),
    )
