"""Rules that look at several events of one key, all evaluated together.

A :class:`GroupRule` selects events, gives each a key, and says what makes a group: a
dense or anchored window, the first window with enough stages, or the whole key. All
rules share one scan of the events (:func:`find_groups` writes its hits), one search for
windows and one summary. A group can
hold any share of the data, so nothing collects a whole group: counts and distinct
counts are aggregated in two steps, and the few evidence rows and names an alert shows
come from a rank filter, which Spark also applies before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.sqltext import lit
from emberwatch.operators.windows import BY, MICROS, assign, first_stage_windows, greedy_windows
from emberwatch.schema import EVIDENCE_CAP, alert_key, epoch_micros, evidence_sql, finish_alerts, with_raw
from emberwatch.sources.store import materialize

DENSE, STAGES, WHOLE = "dense", "stages", "whole"
GROUP = [*BY, "anchor"]

# Evidence fields allowlist entries may look at.
WATCHED = ("username", "computer", "source_ip", "event_id")


@dataclass(frozen=True)
class GroupRule:
    """``test`` is a column over events; every other expression is SQL.

    key, value, bits and evidence are over events; rule_name, severity, description,
    recommendation and having are over the groups: key, n, n_distinct, names (distinct
    values), bits (OR-ed), first_ts, last_ts, evidence.
    """

    detector: str
    test: Column
    key: str
    rule_name: str
    severity: str
    description: str
    tactic: str
    technique: str
    recommendation: str
    evidence: Mapping[str, str]
    kind: str = DENSE
    width_seconds: int = 0
    minimum: int = 1
    value: str = "''"
    bits: str = "0"
    stages: int = 0
    having: str = "true"
    names_shown: int = 5
    evidence_cap: int = EVIDENCE_CAP
    raw: bool = False  # whether it reads the column RAW_COLUMN


def watch_token(field: str, value: str) -> str:
    return f"{field}={value.lower() if field in ('username', 'computer') else value}"


def watch_values(allowlist: Iterable[Mapping] | None) -> dict[str, list[str]]:
    """Values per field that allowlist entries look for in evidence."""
    out: dict[str, list[str]] = {}
    for entry in allowlist or []:
        for field in WATCHED:
            if field in entry:
                text = str(entry[field])
                out.setdefault(field, []).append(text.lower() if field in ("username", "computer") else text)
    return {field: sorted(set(values)) for field, values in out.items()}


def _case(values: list[str]) -> str:
    """SQL that picks the value of the row's rule."""
    if len(set(values)) == 1:
        return values[0]
    return "CASE rule " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def group_rows(events: DataFrame, rules: list[GroupRule]) -> DataFrame:
    """One row per (event, rule it matches), ready for the window search."""
    found = F.array_compact(F.array(*[F.when(r.test, F.lit(i)) for i, r in enumerate(rules)]))
    hits = with_raw(events, any(r.raw for r in rules)).select("*", F.explode(found).alias("rule"))
    return hits.select(
        "rule", F.expr(f"{_case([r.key for r in rules])} AS key"), epoch_micros("event_ts").alias("t"),
        F.expr(f"{_case([f'{int(r.width_seconds) * MICROS}L' for r in rules])} AS width"),
        F.expr(f"{_case([str(int(r.minimum)) for r in rules])} AS minimum"),
        F.expr(f"{_case([r.value for r in rules])} AS value"), F.expr(f"cast({_case([r.bits for r in rules])} as int) AS bits"),
        "event_ts", "event_uid", F.expr(f"{_case([evidence_sql(**r.evidence) for r in rules])} AS item"),
    )


def grouped(rows: DataFrame, rules: list[GroupRule]) -> DataFrame:
    """Rows that belong to a group, with the group's ``anchor`` (0 for whole-key groups)."""

    def of(kind: str) -> list[int]:
        return [i for i, r in enumerate(rules) if r.kind == kind]

    windows = []
    if of(DENSE):
        windows.append(greedy_windows(rows.where(F.col("rule").isin(of(DENSE)))))
    if of(STAGES):
        windows.append(first_stage_windows(rows.where(F.col("rule").isin(of(STAGES))), max(r.stages for r in rules)))
    parts = []
    if windows:
        anchors = windows[0] if len(windows) == 1 else windows[0].unionByName(windows[1])
        # The windows are few and every summary below needs them: found once and written to
        # the shared folder, they also give the join its true size to choose a strategy by.
        anchors = materialize(anchors, "windows")
        windowed = rows.where(F.col("rule").isin(of(DENSE) + of(STAGES))) if of(WHOLE) else rows
        parts.append(assign(windowed, anchors))
    if of(WHOLE):
        whole = rows.where(F.col("rule").isin(of(WHOLE))) if windows else rows
        parts.append(whole.withColumn("anchor", F.lit(0).cast("bigint")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def first_rows(rows: DataFrame, keys: list[str], order: list[str], item: str, cap: int, alias: str) -> DataFrame:
    """(keys, alias): the column ``item`` of the first ``cap`` rows of each group, in order."""
    rank = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)}) AS rank"
    return (
        rows.selectExpr(*keys, item, rank).where(f"rank <= {cap}").groupBy(*keys)
        .agg(F.expr(f"transform(array_sort(collect_list(struct(rank, {item}))), x -> x.{item}) AS {alias}"))
    )


def summarize(rows: DataFrame, rules: list[GroupRule], watch: Mapping[str, list[str]] | None = None) -> DataFrame:
    """One row per group: n, n_distinct, names, bits, first_ts, last_ts, evidence, watch_hits."""
    tests, hits = {}, []
    for field, values in (watch or {}).items():
        text = f"cast(item.{field} as string)"
        text = f"lower({text})" if field in ("username", "computer") else text
        for value in values:
            name = f"watch_{len(hits)}"
            tests[name] = f"coalesce({text} = {lit(value)}, false) AS {name}"
            hits.append(f"CASE WHEN max({name}) THEN {lit(watch_token(field, value))} END")
    by_value = (
        rows.selectExpr(*GROUP, "value", "event_ts", "bits", *tests.values()).groupBy(*GROUP, "value")
        .agg(*map(F.expr, ["count(1) AS n", "min(event_ts) AS first_ts", "max(event_ts) AS last_ts", "bit_or(bits) AS bits",
                           *[f"max({name}) AS {name}" for name in tests]]))
    )
    stats = (
        by_value.groupBy(*GROUP)
        .agg(*map(F.expr, ["sum(n) AS n", "count(1) AS n_distinct", "min(first_ts) AS first_ts", "max(last_ts) AS last_ts",
                           "bit_or(bits) AS bits", f"cast(array_compact(array({', '.join(hits)})) as array<string>) AS watch_hits"]))
        .where(_case([r.having for r in rules]))
    )
    evidence = first_rows(rows, GROUP, ["event_ts", "event_uid"], "item", max(r.evidence_cap for r in rules), "evidence")
    out = stats.join(evidence, GROUP)
    if all(r.value == "''" for r in rules):
        return out.withColumn("names", F.array().cast("array<string>"))
    values = rows.select(*GROUP, "value").distinct()
    return out.join(first_rows(values, GROUP, ["value"], "value", max(r.names_shown for r in rules), "names"), GROUP)


def _described(groups: DataFrame, rules: list[GroupRule]) -> DataFrame:
    """Summarized groups with the texts and labels of their alerts."""
    shown = groups.selectExpr(
        *[c for c in groups.columns if c not in ("names", "evidence")],
        f"slice(names, 1, {_case([str(r.names_shown) for r in rules])}) AS names",
        f"slice(evidence, 1, {_case([str(r.evidence_cap) for r in rules])}) AS evidence",
    )
    return shown.selectExpr(
        *GROUP, f"{_case([lit(r.detector) for r in rules])} AS detector", f"{_case([r.rule_name for r in rules])} AS rule_name",
        f"{_case([r.severity for r in rules])} AS severity", f"{_case([r.description for r in rules])} AS description",
        "first_ts AS alert_ts", f"{_case([lit(r.tactic) for r in rules])} AS mitre_tactic",
        f"{_case([lit(r.technique) for r in rules])} AS mitre_technique",
        f"{_case([r.recommendation for r in rules])} AS recommendation", "n AS evidence_count", "evidence", "watch_hits",
    )


def group_alerts(groups: DataFrame, rules: list[GroupRule]) -> DataFrame:
    """Alerts of summarized groups."""
    return finish_alerts(_described(groups, rules))


def find_groups(events: DataFrame, rules: list[GroupRule]) -> DataFrame:
    """Rows of all groups of all rules, written to the shared folder.

    This is the step of the group pass that runs jobs: one scan of the events writes the
    hits, the windows are found in them, and the hits in windows are written. Counts, names
    and evidence read what is written.
    """
    hits = materialize(group_rows(events, rules), "hits")
    return materialize(grouped(hits, rules), "grouped-hits")


def group_evidence(events: DataFrame, rules: list[GroupRule]) -> DataFrame:
    """Every event of every alert: (alert_id, event_uid, event_ts, item). The alerts themselves carry a first few."""
    rows = find_groups(events, rules)
    named = _described(summarize(rows, rules), rules)
    ids = named.select(*GROUP, alert_key(F.col("rule_name"), F.col("alert_ts"), F.col("description")).alias("alert_id"))
    return rows.join(ids, GROUP).select("alert_id", "event_uid", "event_ts", "item")


def run_group_rules(events: DataFrame, rules: list[GroupRule], watch: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Alerts of all rules over ``events``; runs :func:`find_groups`."""
    return group_alerts(summarize(find_groups(events, rules), rules, watch), rules)
