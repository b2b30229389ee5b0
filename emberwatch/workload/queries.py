"""The registered queries: each is (Spark query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberwatch.operators.bursts import KEYED_DETECTORS, detect
from emberwatch.operators.rowrules import run_row_rules
from emberwatch.operators.stateless import stateless_rules
from emberwatch.schema import ts_text
from emberwatch.workload import alert_sql as sql
from emberwatch.workload.alert_sql import SETTINGS
from emberwatch.workload.tables import sec_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = (fn, oracle)
        return fn

    return add


def alert_view(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "detector", "rule_name", "severity", "description", ts_text("alert_ts").alias("alert_time"),
        "mitre_tactic", "mitre_technique", "evidence_count",
    )


ROW_RULE_NAMES = {
    "suspicious_process": None,
    "log_cleared": "Log Clearing Detected",
    "protection_disabled": "Windows Defender Disabled",
    "audit_policy_changed": "Audit Policy Modified",
    "firewall_change": "Firewall Rule Modification",
    "new_service": "New Service Created",
    "scheduled_task": "Scheduled Task Created",
    "run_key": "Registry Run Key Modified",
    "startup_folder": "Startup Folder Modified",
    "archive": "Suspicious Archive Creation",
    "staging": "Data Staging Detected",
    "kerberoasting": "Potential Kerberoasting",
    "asrep_roasting": "Potential AS-REP Roasting",
    "lsass_access": "LSASS Memory Access",
    "sam_access": "SAM Hive Access",
    "directory_replication": "Directory Replication Request",
    "external_rdp": "External RDP Logon",
    "after_hours": "After-Hours Logon",
}


def _row_query(name: str, rule_name: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        detector = sql.ROW_SQL[name].split("'")[1]
        rules = [r for r in stateless_rules(SETTINGS, [detector]) if rule_name is None or (isinstance(r.rule_name, str) and r.rule_name == rule_name)]
        return alert_view(run_row_rules(sec_events(spark, sf_dir), rules))

    return run


def _keyed_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return alert_view(detect(sec_events(spark, sf_dir), name, SETTINGS))

    return run


for _name, _rule in ROW_RULE_NAMES.items():
    register(f"detect_{_name}", sql.row_oracle(_name))(_row_query(_name, _rule))
for _name in KEYED_DETECTORS:
    register(f"detect_{_name}", sql.keyed_oracle(_name))(_keyed_query(_name))
