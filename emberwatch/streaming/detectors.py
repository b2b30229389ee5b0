"""Keyed detectors over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from emberwatch.operators.bursts import KEYED_DETECTORS
from emberwatch.operators.settings import DetectorSettings
from emberwatch.streaming.live import live_windows

# The detectors whose groups are time windows.
LIVE_DETECTORS = ["brute_force", "lateral_movement", "discovery", "dns_exfiltration", "attack_chain"]


def live_detector(events: DataFrame, detector: str, settings: DetectorSettings | None = None,
                  delay: str = "10 minutes") -> DataFrame:
    """Alerts of one windowed detector over a stream of events."""
    if detector not in LIVE_DETECTORS:
        raise ValueError(f"{detector} is not a windowed detector")
    return live_windows(events, KEYED_DETECTORS[detector](settings or DetectorSettings()), delay)
