"""Own detectors: registering them and adapting Python functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.operators.settings import CATALOG, DetectorSettings
from emberwatch.operators.windows import anchored_windows
from emberwatch.plans.scan import Detector
from emberwatch.schema import evidence_struct, finish_alerts

# What an own Python function returns per alert.
FINDING_DDL = (
    "rule_name string, severity string, description string, alert_ts timestamp_ntz, mitre_tactic string, "
    "mitre_technique string, recommendation string, evidence_count bigint, username string, computer string, source_ip string"
)

_registered: dict[str, Detector] = {}


def register_detector(name: str, detector: Detector) -> None:
    """Make a function (events, settings) -> alerts known under a name."""
    if name in _registered:
        raise ValueError(f"detector {name!r} is registered already")
    _registered[name] = detector


def registered_detectors() -> tuple[tuple[str, Detector], ...]:
    """For ``ScanConfig(detectors=...)``."""
    return tuple(_registered.items())


def detector_catalog(spark: SparkSession) -> DataFrame:
    """Name, description and labels of the built-in detectors, and the names of own ones."""
    own = [(name, name, "", "", "") for name in _registered]
    return spark.createDataFrame(
        [*CATALOG, *own],
        "detector string, name string, description string, mitre_tactic string, mitre_technique string",
    )


def _as_alerts(name: str, findings: DataFrame) -> DataFrame:
    evidence = evidence_struct(
        timestamp="substring(cast(alert_ts as string), 1, 19)", username="username", computer="computer", source_ip="source_ip"
    )
    return finish_alerts(findings.withColumns({"detector": F.lit(name), "evidence": F.array(evidence)}))


def batch_detector(name: str, find: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str]) -> Detector:
    """Detector from a pandas function over batches of events; it must judge each row by itself.

    Only the named event columns are sent to Python.
    """

    def detect(events: DataFrame, settings: DetectorSettings) -> DataFrame:
        def over_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield find(batch)

        return _as_alerts(name, events.select(*columns).mapInPandas(over_batches, FINDING_DDL))

    return detect


def window_detector(name: str, find: Callable[[pd.DataFrame], pd.DataFrame], key: str | Column, columns: list[str],
                    window_seconds: int) -> Detector:
    """Detector from a pandas function over the events of one key in one anchored window.

    The window bounds what a Python task holds, however many events a key has in all.
    """

    def detect(events: DataFrame, settings: DetectorSettings) -> DataFrame:
        rows = anchored_windows(events, key, window_seconds).select("key", "anchor", *columns)
        return _as_alerts(name, rows.groupBy("key", "anchor").applyInPandas(find, FINDING_DDL))

    return detect


class Sequence:
    """What :func:`sequence_detector` carries along one group; subclass it."""

    def add(self, events: pd.DataFrame) -> None:
        """The group's next events in order of time and id; a group comes in many parts."""
        raise NotImplementedError

    def finding(self) -> dict | None:
        """The group's finding (columns of ``FINDING_DDL``) after its last event, or None."""
        raise NotImplementedError


def sequence_detector(name: str, start: Callable[[], Sequence], key: str | Column, columns: list[str], window_seconds: int) -> Detector:
    """Detector that reads the events of one key in one anchored window in order, a batch at a time.

    ``start`` makes the carried state of a group. A window of any number of events takes the
    memory of a batch: Spark sorts the rows of a task, spilling to disk, and hands them on in parts.
    """

    def detect(events: DataFrame, settings: DetectorSettings) -> DataFrame:
        rows = anchored_windows(events, key, window_seconds).select("key", "anchor", "t", "event_uid", *[F.col(c).alias(f"c_{c}") for c in columns])
        ordered = rows.repartition("key", "anchor").sortWithinPartitions("key", "anchor", "t", "event_uid")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            group, state = None, None
            for batch in batches:
                out = []
                new = (batch["key"].ne(batch["key"].shift()) | batch["anchor"].ne(batch["anchor"].shift())).cumsum()
                for _, part in batch.groupby(new, sort=False):
                    at = (part["key"].iloc[0], part["anchor"].iloc[0])
                    if at != group:
                        if state is not None and (found := state.finding()) is not None:
                            out.append(found)
                        group, state = at, start()
                    state.add(part[[f"c_{c}" for c in columns]].set_axis(columns, axis=1))
                if out:
                    yield pd.DataFrame(out)
            if state is not None and (found := state.finding()) is not None:
                yield pd.DataFrame([found])

        return _as_alerts(name, ordered.mapInPandas(run, FINDING_DDL))

    return detect
