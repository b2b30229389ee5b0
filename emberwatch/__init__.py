"""Security-log analytics as Spark jobs: events in, alerts and incidents out."""

from emberwatch.plans.scan import ScanConfig, run_detections
from emberwatch.schema import ALERT_COLUMNS, EVENT_COLUMNS, normalize_events

__all__ = ["ALERT_COLUMNS", "EVENT_COLUMNS", "ScanConfig", "normalize_events", "run_detections"]
