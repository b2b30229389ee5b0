"""The scan: every detector and rule over one event DataFrame."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from emberwatch.operators.alerts import group_rows, run_group_rules, watch_values
from emberwatch.operators.bursts import KEYED_DETECTORS
from emberwatch.operators.fieldrules import count_rule, split_field_rules
from emberwatch.operators.post import apply_allowlist, at_least
from emberwatch.operators.rowrules import RowRule, run_row_rules
from emberwatch.operators.sigma import sigma_row_rule
from emberwatch.operators.settings import CATALOG, DetectorSettings
from emberwatch.operators.stateless import STATELESS_DETECTORS, stateless_rules
from emberwatch.schema import ALERT_COLUMNS, empty_alerts, union_all

log = logging.getLogger(__name__)

Detector = Callable[[DataFrame, DetectorSettings], DataFrame]


@dataclass(frozen=True)
class ScanConfig:
    settings: DetectorSettings = field(default_factory=DetectorSettings)
    exclude: tuple[str, ...] = ()  # case-insensitive parts of detector ids or names
    field_rules: tuple[dict, ...] = ()
    sigma_rules: tuple[dict, ...] = ()
    detectors: tuple[tuple[str, Detector], ...] = ()  # own detectors: (name, function)
    allowlist: tuple[dict, ...] = ()
    min_severity: str = "info"


def _excluded(detector: str, name: str, config: ScanConfig) -> bool:
    return any(e and e.lower() in text.lower() for e in config.exclude for text in (detector, name))


def run_detections(events: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Alerts of the scan that reach ``min_severity`` and are not on the allowlist."""
    return scan_alerts(events, config)[0]


def scan_alerts(events: DataFrame, config: ScanConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(alerts kept, alerts the allowlist suppresses with ``reason``), both of ``min_severity`` and above."""
    config = config or ScanConfig()
    found = at_least(all_alerts(events, config), config.min_severity)
    return apply_allowlist(found, config.allowlist)


def all_alerts(events: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """All alerts of built-in detectors, rules and own detectors over ``events``.

    Single-event detectors, per-event rules and Sigma rules share one pass; keyed detectors
    and counting rules share another. A detector that cannot be built is skipped with a
    warning, the others still run.
    """
    config = config or ScanConfig()
    names = {row[0]: row[1] for row in CATALOG}
    watch = watch_values(config.allowlist)
    wanted = [d for d in STATELESS_DETECTORS if not _excluded(d, names[d], config)]
    single: list[RowRule] = stateless_rules(config.settings, wanted)
    frames: list[DataFrame] = []

    def attempt(name: str, build: Callable[[], object]):
        try:
            return build()
        except Exception as exc:  # noqa: BLE001 - a broken rule must not stop the scan
            log.warning("detector %s skipped: %s", name, exc)
            return None

    def usable(rules: list, build: Callable[[list], DataFrame]) -> list:
        """The rules Spark can analyze; they are tried one by one only if not all together pass."""
        if not config.field_rules and not config.sigma_rules:
            return rules
        try:
            build(rules)
            return rules
        except Exception:  # noqa: BLE001
            return [r for r in rules if attempt(r.detector, lambda r=r: build([r])) is not None]

    per_event, grouped = split_field_rules(config.field_rules)
    single += [r for rule in per_event if (r := attempt(rule.name, rule.row_rule)) is not None]
    for i, rule in enumerate(config.sigma_rules):
        made = attempt(str(rule.get("title")), lambda i=i, rule=rule: sigma_row_rule(rule, i))
        if made is not None:
            single.append(made)
    single = usable(single, lambda rules: run_row_rules(events, rules))
    if single:
        frames.append(run_row_rules(events, single))
    several = [make(config.settings) for name, make in KEYED_DETECTORS.items() if not _excluded(name, names[name], config)]
    several += [r for rule in grouped if (r := attempt(rule.name, lambda rule=rule: count_rule(rule))) is not None]
    several = usable(several, lambda rules: group_rows(events, rules))
    if several:
        frames.append(run_group_rules(events, several, watch))
    for name, detect in config.detectors:
        made = attempt(name, lambda detect=detect: detect(events, config.settings).select(*ALERT_COLUMNS))
        if made is not None:
            frames.append(made)
    return union_all(frames) if frames else empty_alerts(events.sparkSession)
