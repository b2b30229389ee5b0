"""User rules over event fields: conditions, grouping, thresholds.

A rule is a plain dict::

    {"name": ..., "description": ..., "severity": "medium",
     "conditions": [{"field": ..., "operator": ..., "value": ...}],
     "group_by": "", "threshold": 1, "window_seconds": 300,
     "mitre_tactic": "", "mitre_technique": "", "recommendation": ""}
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.events import raw_text_sql
from emberwatch.functions.sqltext import EVENT_TIME, USER_OR_TARGET, lit
from emberwatch.functions.text import number_or_zero, search
from emberwatch.operators.alerts import DENSE, WHOLE, GroupRule, run_group_rules
from emberwatch.operators.rowrules import RowRule
from emberwatch.operators.ruleindex import Literal, Literals, all_of
from emberwatch.schema import EVENT_COLUMNS, RAW_COLUMN, SEVERITIES


def is_raw_field(name: str) -> bool:
    """Whether a field stands in the raw record."""
    return name not in ("timestamp", "timestamp_str", "event_ts", "raw") and name not in EVENT_COLUMNS


def event_field_sql(name: str, raw: str = "try_parse_json(raw_json)") -> str:
    """Text of an event column, of ``raw.a.b``, or of a raw or ``EventData`` key; else ``''``.

    ``raw`` is the parsed record; rules name the column ``RAW_COLUMN``, which a pass makes once.
    """
    if name in ("timestamp", "timestamp_str", "event_ts"):
        return EVENT_TIME
    if name == "raw":
        return "raw_json"
    if name in EVENT_COLUMNS:
        return f"coalesce(cast({name} as string), '')"
    if name.startswith("raw."):
        return f"coalesce({raw_text_sql(raw, *name.split('.')[1:])}, '')"
    return f"coalesce({raw_text_sql(raw, name)}, {raw_text_sql(raw, 'EventData', name)}, '')"


def event_field(name: str, raw: str = "try_parse_json(raw_json)") -> Column:
    return F.expr(event_field_sql(name, raw))


def _number(value) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return 0.0


def _low(value) -> Column:
    return F.lit(str(value).lower())


# Operator name to predicate over the field's text and the rule's value.
OPERATORS = {
    "equals": lambda text, v: F.lower(text) == _low(v),
    "not_equals": lambda text, v: F.lower(text) != _low(v),
    "contains": lambda text, v: F.lower(text).contains(_low(v)),
    "not_contains": lambda text, v: ~F.lower(text).contains(_low(v)),
    "startswith": lambda text, v: F.lower(text).startswith(_low(v)),
    "endswith": lambda text, v: F.lower(text).endswith(_low(v)),
    "regex": lambda text, v: search(text, v),
    "gt": lambda text, v: number_or_zero(text) > _number(v),
    "lt": lambda text, v: number_or_zero(text) < _number(v),
    "gte": lambda text, v: number_or_zero(text) >= _number(v),
    "lte": lambda text, v: number_or_zero(text) <= _number(v),
    "in": lambda text, v: F.lower(text).isin([str(x).lower() for x in v]),
}


def conditions_test(conditions: Iterable[Mapping], raw: str = "try_parse_json(raw_json)") -> Column:
    """All conditions hold; an unknown operator is skipped and no condition matches all."""
    tests = [
        OPERATORS[op](event_field(c.get("field", ""), raw), c.get("value", ""))
        for c in conditions
        if (op := c.get("operator", "equals")) in OPERATORS
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def condition_literals(conditions: Iterable[Mapping]) -> Literals | None:
    """Texts of which one is there if all conditions hold."""
    found: list[Literals | None] = []
    for c in conditions:
        field, op, value = event_field_sql(c.get("field", ""), RAW_COLUMN), c.get("operator", "equals"), c.get("value", "")
        if op in ("contains", "startswith", "endswith"):
            found.append(frozenset([Literal(field, str(value).lower())]))
        elif op in ("equals", "in"):
            found.append(frozenset(Literal(field, str(v).lower(), True) for v in (value if op == "in" else [value])))
    return all_of(found)


@dataclass(frozen=True)
class FieldRule:
    name: str
    description: str
    severity: str
    conditions: tuple[Mapping, ...]
    group_by: str
    threshold: int
    window_seconds: int
    tactic: str
    technique: str
    recommendation: str

    @classmethod
    def of(cls, rule: Mapping) -> FieldRule:
        severity = str(rule.get("severity", "medium")).lower()
        if severity not in SEVERITIES:
            raise ValueError(f"severity {severity!r} of rule {rule.get('name')!r}")
        return cls(
            rule.get("name", "Custom Rule"), rule.get("description", ""), severity,
            tuple(rule.get("conditions", ())), rule.get("group_by", ""), int(rule.get("threshold", 1)),
            int(rule.get("window_seconds", 300)), rule.get("mitre_tactic", ""), rule.get("mitre_technique", ""),
            rule.get("recommendation", ""),
        )

    @property
    def per_event(self) -> bool:
        return not self.group_by and self.threshold <= 1

    def test(self) -> Column:
        return conditions_test(self.conditions, RAW_COLUMN)

    @property
    def raw(self) -> bool:
        return any(is_raw_field(f) for f in [c.get("field", "") for c in self.conditions] + [self.group_by] * bool(self.group_by))

    def evidence(self, **more: str) -> dict[str, str]:
        return {"timestamp": EVENT_TIME, "event_id": "event_id", "computer": "computer", "username": USER_OR_TARGET, **more}

    def row_rule(self) -> RowRule:
        return RowRule(
            f"rule:{self.name}", self.test(), self.name, self.severity, F.lit(self.description),
            self.tactic, self.technique, self.recommendation, self.evidence(), literals=condition_literals(self.conditions), raw=self.raw,
        )


def split_field_rules(rules: Iterable[Mapping]) -> tuple[list[FieldRule], list[FieldRule]]:
    """Rules that look at one event, and rules that count events."""
    made = [FieldRule.of(r) for r in rules]
    return [r for r in made if r.per_event], [r for r in made if not r.per_event]


def count_rule(rule: FieldRule) -> GroupRule:
    """A counting rule: per key and anchored window, per key, or over everything."""
    windowed = bool(rule.group_by) and rule.window_seconds > 0
    key, tail = "''", lit(" matching event(s)")
    more = {}
    if rule.group_by:
        key = event_field_sql(rule.group_by, RAW_COLUMN)
        quote = chr(39)
        tail = f"concat({lit(' matching event(s) for ' + rule.group_by + '=' + quote)}, key, {lit(quote)})"
        more = {"group_key": key}
    return GroupRule(
        f"rule:{rule.name}", rule.test(), key, lit(rule.name), lit(rule.severity),
        f"concat({lit(rule.description + ': ')}, cast(n as string), {tail})", rule.tactic, rule.technique,
        lit(rule.recommendation), rule.evidence(**more), kind=DENSE if windowed else WHOLE,
        width_seconds=rule.window_seconds if windowed else 0, having=f"n >= {rule.threshold}", raw=rule.raw,
    )


def field_rule_alerts(events: DataFrame, rules: Iterable[FieldRule], watch=None) -> DataFrame:
    """Alerts of counting rules."""
    return run_group_rules(events, [count_rule(r) for r in rules], watch)
