"""Event, evidence and alert layouts shared by every operator.

Text columns of the event table are never NULL: absence is ``''``. That is what
lets the operators write ``a or b`` fallbacks as :func:`first_text`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity labels from weakest to strongest.
SEVERITIES = ["info", "low", "medium", "high", "critical"]

TEXT_COLUMNS = [
    "source", "category", "computer", "username", "domain", "source_ip",
    "process_name", "command_line", "status", "parent_process", "target_username",
    "agent_id", "agent_name", "mitre_tactic", "mitre_technique", "event_source",
    "event_hash",
]
INT_COLUMNS = ["event_id", "logon_type"]

EVENT_TYPES = {
    "event_uid": "string",
    "event_ts": "timestamp_ntz",
    "ts_valid": "boolean",
    "event_id": "int",
    "source": "string",
    "category": "string",
    "computer": "string",
    "username": "string",
    "domain": "string",
    "source_ip": "string",
    "process_name": "string",
    "command_line": "string",
    "logon_type": "int",
    "status": "string",
    "parent_process": "string",
    "target_username": "string",
    "agent_id": "string",
    "agent_name": "string",
    "mitre_tactic": "string",
    "mitre_technique": "string",
    "event_source": "string",
    "event_hash": "string",
    "raw_json": "string",
}
EVENT_COLUMNS = list(EVENT_TYPES)
EVENT_DDL = ", ".join(f"{name} {kind}" for name, kind in EVENT_TYPES.items())

# The parsed raw record, a VARIANT column that passes with rules over raw fields make once;
# tables landed with it are read as they are.
RAW_COLUMN = "raw_record"

# Time given to a record whose timestamp cannot be read (``ts_valid`` is false).
UNKNOWN_TIME = "0001-01-01 00:00:00"

EVIDENCE_TYPES = {
    "timestamp": "string",
    "source_ip": "string",
    "username": "string",
    "target_username": "string",
    "event_id": "int",
    "computer": "string",
    "logon_type": "int",
    "process": "string",
    "parent_process": "string",
    "command_line": "string",
    "stage": "string",
    "query": "string",
    "privileges": "array<string>",
    "encryption_type": "string",
    "hour": "int",
    "group_key": "string",
    "sigma_rule": "string",
}
EVIDENCE_DDL = "struct<" + ",".join(f"{n}:{t}" for n, t in EVIDENCE_TYPES.items()) + ">"
EVIDENCE_CAP = 10  # evidence rows an alert carries; evidence_count has the true number

ALERT_TYPES = {
    "alert_id": "string",
    "detector": "string",
    "rule_name": "string",
    "severity": "string",
    "severity_rank": "int",
    "description": "string",
    "alert_ts": "timestamp_ntz",
    "mitre_tactic": "string",
    "mitre_technique": "string",
    "recommendation": "string",
    "evidence_count": "bigint",
    "evidence_truncated": "boolean",
    "evidence": f"array<{EVIDENCE_DDL}>",
    "watch_hits": "array<string>",
}
ALERT_COLUMNS = list(ALERT_TYPES)
ALERT_DDL = ", ".join(f"{name} {kind}" for name, kind in ALERT_TYPES.items())


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def first_text(*values: str | Column) -> Column:
    """First non-empty text among ``values``, else ``''``."""
    return F.coalesce(*[F.nullif(col(v), F.lit("")) for v in values], F.lit(""))


def ts_text(ts: str | Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``. A cast, since date_format would apply the session zone."""
    return F.substring(col(ts).cast("string"), 1, 19)


def ts_iso(ts: str | Column) -> Column:
    """ISO text with microseconds only when there are any."""
    text = col(ts).cast("string")
    whole = F.replace(F.substring(text, 1, 19), F.lit(" "), F.lit("T"))
    return F.when(F.length(text) <= 19, whole).otherwise(
        F.concat(whole, F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0"))
    )


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp column, whatever the session zone."""
    return F.expr(
        f"(cast(unix_date(cast({ts} as date)) as bigint) * 86400 + hour({ts}) * 3600 + minute({ts}) * 60) * 1000000 "
        f"+ cast(extract(SECOND FROM {ts}) * 1000000 as bigint)"
    )


def severity_rank(severity: str | Column) -> Column:
    """Position of a severity label in :data:`SEVERITIES`."""
    return (F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), col(severity)) - 1).cast("int")


def evidence_sql(**fields: str) -> str:
    """One evidence row from SQL expressions; fields a detector does not report stay NULL."""
    unknown = set(fields) - set(EVIDENCE_TYPES)
    if unknown:
        raise ValueError(f"not evidence fields: {sorted(unknown)}")
    items = [f"'{name}', cast({fields.get(name, 'null')} as {kind})" for name, kind in EVIDENCE_TYPES.items()]
    return f"named_struct({', '.join(items)})"


def evidence_struct(**fields: str) -> Column:
    return F.expr(evidence_sql(**fields))


def alert_key(rule_name: Column, ts: Column, description: Column) -> Column:
    """Stable id of an alert: SHA-256 over rule, ISO time and description."""
    return F.sha2(F.concat(rule_name, ts_iso(ts), description), 256)


def finish_alerts(df: DataFrame) -> DataFrame:
    """Add the derived alert columns and put everything in :data:`ALERT_COLUMNS` order.

    ``df`` must carry detector, rule_name, severity, description, alert_ts, the MITRE
    labels, recommendation, evidence_count and evidence.
    """
    derived = {
        "severity_rank": "array_position(array(" + ", ".join(f"'{x}'" for x in SEVERITIES) + "), severity) - 1",
        "evidence_truncated": "evidence_count > size(evidence)",
        "watch_hits": "watch_hits" if "watch_hits" in df.columns else "array()",
    }
    keyed = df.withColumn("alert_id", alert_key(F.col("rule_name"), F.col("alert_ts"), F.col("description")))
    return keyed.selectExpr(
        *[f"cast({derived.get(name, name)} as {kind}) AS {name}" for name, kind in ALERT_TYPES.items()]
    )


def normalize_events(df: DataFrame) -> DataFrame:
    """Bring any DataFrame with some of the event columns to the full event layout."""
    have = set(df.columns)
    if not {"event_uid", "event_ts"} <= have:
        raise ValueError("events need event_uid and event_ts")
    defaults = {name: "''" for name in TEXT_COLUMNS} | {name: "0" for name in INT_COLUMNS}
    defaults |= {"raw_json": "'{}'", "ts_valid": "true", "event_uid": "null", "event_ts": "null"}
    return df.selectExpr(
        *[
            f"coalesce(cast({name if name in have else 'null'} as {kind}), cast({defaults[name]} as {kind})) AS {name}"
            for name, kind in EVENT_TYPES.items()
        ]
    )


def empty_alerts(spark) -> DataFrame:
    return spark.createDataFrame([], ALERT_DDL)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections refer to without repeating them.

    Spark copies the expression of a plain column into every filter above it. The output
    of explode is never copied back, so costly parses run once per row.
    """
    bound = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.explode(bound).alias("_once")).select(*df.columns, "_once.*")


def with_raw(events: DataFrame, needed: bool = True) -> DataFrame:
    """Events with the raw record parsed once, unless it is not ``needed`` or there already."""
    if not needed or RAW_COLUMN in events.columns:
        return events
    return computed_once(events, **{RAW_COLUMN: F.try_parse_json("raw_json")})
