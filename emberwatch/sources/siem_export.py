"""Alert exports of a SIEM as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.events import level_severity, path_texts, shape_category
from emberwatch.functions.sqltext import lit
from emberwatch.functions.timestamps import or_unknown, siem_time
from emberwatch.schema import computed_once, normalize_events
from emberwatch.sources.lines import line_uid, read_lines

# Keys that may wrap the list of alerts, in order.
WRAPPERS = ["affected_items", "items", "alerts", "data"]
INNER_WRAPPERS = ["affected_items", "items", "alerts"]

# Paths per event column, in order, and defaults.
PATHS = {
    "time": ["timestamp", "@timestamp", "rule.firedtimes"],
    "event_id": ["rule.id", "decoder.id"],
    "source": ["location", "rule.groups"],
    "computer": ["agent.name", "agent.hostname", "data.host.name"],
    "username": [
        "data.user", "data.username", "data.win.eventdata.SubjectUserName",
        "data.win.eventdata.TargetUserName", "user.name",
    ],
    "domain": ["data.domain", "data.win.eventdata.TargetDomainName"],
    "source_ip": ["srcip", "source.ip", "data.srcip", "data.win.eventdata.IpAddress"],
    "process_name": ["data.process", "data.win.eventdata.Image", "data.win.system.providerName", "rule.groups"],
    "command_line": ["data.command_line", "data.win.eventdata.CommandLine", "data.process.command_line"],
    "logon_type": ["data.win.eventdata.LogonType", "data.logon_type"],
    "status": ["data.status", "data.win.eventdata.Status"],
    "parent_process": ["data.parent_process", "data.win.eventdata.ParentImage"],
    "target_username": ["data.win.eventdata.TargetUserName", "data.target_user"],
    "agent_id": ["agent.id"],
    "agent_name": ["agent.name"],
    "mitre_tactic": ["rule.mitre.tactic", "rule.groups"],
    "mitre_technique": ["rule.mitre.id", "rule.mitre.technique"],
    "event_source": ["rule.description"],
    "level": ["rule.level"],
}
DEFAULTS = {"source": "siem", "computer": "siem-agent", "event_source": "SIEM alert"}


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _objects(items: Column) -> Column:
    return F.filter(items, _is_object)


def unwrap(raw: Column) -> Column:
    """The alerts inside one document: a bare list, or a list below one of the wrapper keys."""

    def items(path: str) -> Column:
        return F.try_variant_get(raw, path, "array<variant>")

    found = [items("$")]
    for key in WRAPPERS:
        node = F.try_variant_get(raw, f"$.{key}", "map<string,variant>")
        found.append(items(f"$.{key}"))
        found += [items(f"$.{key}.{inner}") for inner in INNER_WRAPPERS]
        values = F.map_values(node)
        found.append(F.when(F.forall(values, _is_object), values))
    return _objects(F.coalesce(*found))


def export_events(alerts: DataFrame) -> DataFrame:
    """Events of (raw VARIANT, src_file, line_id) alert rows, with ``severity`` of the rule level."""
    distinct = sorted({p for paths in PATHS.values() for p in paths})
    texts = computed_once(alerts, texts=path_texts("raw", distinct))

    def first(paths: list[str], default: str):
        return F.expr("coalesce(" + ", ".join(f"texts[{distinct.index(p)}]" for p in paths) + f", {lit(default)})")

    fields = computed_once(texts, **{name: first(paths, DEFAULTS.get(name, "")) for name, paths in PATHS.items()})
    ts = siem_time("time")

    def whole(name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("int"), F.lit(0))

    return fields.withColumns(
        {
            "event_uid": line_uid(),
            "event_ts": or_unknown(ts),
            "ts_valid": ts.isNotNull(),
            "event_id": whole("event_id"),
            "logon_type": whole("logon_type"),
            "category": shape_category(whole("event_id"), "process_name", "command_line", "source_ip", "username"),
            "severity": level_severity(whole("level")),
            "raw_json": F.to_json("raw"),
        }
    )


def read_siem_export(spark: SparkSession, path: str, layout: str = "files", **options: str) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of exported alerts. Each document is a list of alerts, or an object that wraps one.

    ``layout`` is ``files`` (one document per file) or ``lines`` (one page per line, which
    is the form to use for large exports: long files are split over many tasks).
    """
    if layout == "lines":
        docs = computed_once(read_lines(spark, path, **options), raw=F.try_parse_json("value"))
    else:
        whole = spark.read.options(**options).option("multiLine", True).option("singleVariantColumn", "raw").json(path)
        docs = whole.select(
            F.col("_metadata.file_path").alias("value"), F.col("_metadata.file_path").alias("src_file"), F.lit(0).cast("bigint").alias("line_id"), "raw"
        )
    docs = computed_once(docs, items=unwrap(F.col("raw")))
    bad = docs.where("items IS NULL").select(
        "value", "src_file", "line_id", F.when(F.col("raw").isNull(), "malformed").otherwise("no alerts").alias("reason")
    )
    # Numbered by document and place in it: pages hold less than 2**24 alerts.
    items = docs.select(F.posexplode("items").alias("at", "raw"), "src_file", "line_id").withColumn("line_id", F.expr("line_id * 16777216 + at"))
    return normalize_events(export_events(items.drop("at"))), bad


def newer_than(alerts: DataFrame, last_id: int, id_column: str = "id") -> DataFrame:
    """Incremental pull: alerts with an id above the last one seen."""
    return alerts.where(F.col(id_column).cast("bigint") > last_id)
