"""One pass over the events for any number of single-event rules.

Each rule is a predicate plus the alert it raises. Up to ``RULES_PER_ARRAY`` predicates are
evaluated in one array expression over one scan; rows without a hit are dropped before any
alert text is built. Of more rules, those that name fixed texts (:attr:`RowRule.literals`)
go through an index: one scan finds which groups of rules an event can match at all and
writes these few events, and each group is evaluated on its own ones only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import compress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.sqltext import lit
from emberwatch.functions.text import first_match
from emberwatch.operators.ruleindex import Literals, RuleIndex
from emberwatch.schema import evidence_struct, finish_alerts, union_all, with_raw
from emberwatch.sources.store import materialize

RULES_PER_ARRAY = 100  # predicates per generated array; keeps the generated code compilable


@dataclass(frozen=True)
class RowRule:
    """A rule that looks at one event and raises at most one alert for it."""

    detector: str
    test: Column
    rule_name: str | Column
    severity: str | Column
    description: Column
    tactic: str | Column
    technique: str | Column
    recommendation: str
    evidence: dict[str, str] = field(default_factory=dict)  # evidence field to SQL expression
    inputs: dict[str, Column] = field(default_factory=dict)  # helper columns the others refer to by name
    raw: bool = False  # whether it reads the column RAW_COLUMN
    literals: Literals | None = None  # texts of which an event that matches holds one; None if there are none to name


def _value(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _per_rule(rules: list[RowRule], pick) -> Column:
    """The picked attribute of the hit's rule. Constants become one literal array lookup."""
    values = [pick(rule) for rule in rules]
    if all(isinstance(v, str) for v in values):
        return F.expr(f"element_at(array({', '.join(lit(v) for v in values)}), hit + 1)")
    cases = [(F.col("hit") == i, _value(v)) for i, v in enumerate(values)]
    return first_match(cases, F.lit(None))


def _hits(events: DataFrame, rules: list[RowRule]) -> DataFrame:
    # The array goes straight into explode: as a column of its own, the filter Spark
    # infers from explode would evaluate every predicate a second time.
    arrays = [
        F.array(*[F.when(rules[i].test, F.lit(i)) for i in range(k, min(k + RULES_PER_ARRAY, len(rules)))]) for k in range(0, len(rules), RULES_PER_ARRAY)
    ]
    found = F.array_compact(F.concat(*arrays) if len(arrays) > 1 else arrays[0])
    inputs = {name: column for rule in rules for name, column in rule.inputs.items()}
    events = with_raw(events, any(rule.raw for rule in rules))
    return events.select("*", *[c.alias(n) for n, c in inputs.items()]).select("*", F.explode(found).alias("hit"))


def _alerts(events: DataFrame, rules: list[RowRule]) -> DataFrame:
    shapes: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        shapes.setdefault(repr(sorted(rule.evidence.items())), []).append(i)
    structs = [
        (F.col("hit").isin(members), evidence_struct(**rules[members[0]].evidence))
        for members in shapes.values()
    ]
    return finish_alerts(
        _hits(events, rules).select(
            _per_rule(rules, lambda r: r.detector).alias("detector"),
            _per_rule(rules, lambda r: r.rule_name).alias("rule_name"),
            _per_rule(rules, lambda r: r.severity).alias("severity"),
            _per_rule(rules, lambda r: r.description).alias("description"),
            F.col("event_ts").alias("alert_ts"),
            _per_rule(rules, lambda r: r.tactic).alias("mitre_tactic"),
            _per_rule(rules, lambda r: r.technique).alias("mitre_technique"),
            _per_rule(rules, lambda r: r.recommendation).alias("recommendation"),
            F.lit(1).cast("bigint").alias("evidence_count"),
            F.array(first_match(structs, F.lit(None))).alias("evidence"),
        )
    )


def run_row_rules(events: DataFrame, rules: list[RowRule]) -> DataFrame:
    """Alerts of all rules over ``events``: one row per (event, matching rule).

    With more than ``RULES_PER_ARRAY`` rules this runs the job of the rule index; a stream evaluates all rules in one pass.
    """
    if not rules:
        raise ValueError("no rules")
    if len(rules) <= RULES_PER_ARRAY or events.isStreaming:
        return _alerts(events, rules)
    named = [r.literals is not None and all(x.usable for x in r.literals) for r in rules]
    indexed, rest = list(compress(rules, named)), [r for r, n in zip(rules, named, strict=True) if not n]
    frames = [_alerts(events, rest)] if rest else []
    return union_all(frames + _indexed_alerts(events, indexed)) if indexed else frames[0]


def _indexed_alerts(events: DataFrame, rules: list[RowRule]) -> list[DataFrame]:
    groups = [rules[k : k + RULES_PER_ARRAY] for k in range(0, len(rules), RULES_PER_ARRAY)]
    index = RuleIndex([[r.literals for r in group] for group in groups])
    candidates = materialize(index.candidates(with_raw(events, any(r.raw for r in rules))), "rule-candidates", partition_by="rule_group")
    return [_alerts(candidates.where(F.col("rule_group") == k).drop("rule_group"), group) for k, group in enumerate(groups)]
