from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import bursts
from emberwatch.operators.alerts import watch_values
from emberwatch.operators.rowrules import run_row_rules
from emberwatch.operators.settings import DetectorSettings
from emberwatch.operators.stateless import stateless_rules
from emberwatch.plans.registry import batch_detector, detector_catalog, window_detector
from emberwatch.plans.scan import ScanConfig, all_alerts, run_detections, scan_alerts


def single(events, rows, **settings):
    found = run_row_rules(events.frame(rows), stateless_rules(DetectorSettings(**settings)))
    return sorted((r.rule_name, r.severity) for r in found.collect())


def fails(n, step=5, **fields):
    return [(i * step, 4625, {"source_ip": "10.0.1.50", "username": "admin", **fields}) for i in range(n)]


@pytest.mark.parametrize("n,severity", [(4, None), (5, "medium"), (10, "high"), (15, "critical")])
def test_brute_force_levels(events, n, severity):
    got = bursts.detect(events.frame(fails(n)), "brute_force").collect()
    assert [(r.rule_name, r.severity, r.evidence_count) for r in got] == (
        [] if severity is None else [("Brute-Force Detected", severity, n)]
    )
    if severity:
        assert len(got[0].evidence) == min(n, 10) and got[0].evidence_truncated == (n > 10)
        assert got[0].evidence[0].timestamp == "2024-01-15 08:30:00"


def test_spray_and_separate_bursts(events):
    spray = [(i * 2, 4625, {"source_ip": "1.1.1.1", "username": f"u{i}"}) for i in range(5)]
    two = fails(6) + [(400 + s, e, f) for s, e, f in fails(6)]
    got = bursts.detect(events.frame(spray + two), "brute_force").orderBy("rule_name", "alert_ts").collect()
    assert [(r.rule_name, r.evidence_count) for r in got] == [
        ("Brute-Force Detected", 6), ("Brute-Force Detected", 6), ("Password Spray Detected", 5),
    ]
    assert got[2].recommendation.endswith("u0, u1, u2, u3, u4")


def test_lateral_movement(events):
    hosts = [(i * 60, 4624, {"target_username": "eve", "computer": f"H{i}", "logon_type": 10 if i == 1 else 3}) for i in range(3)]
    system = [(i, 4624, {"target_username": "SYSTEM", "computer": f"H{i}", "logon_type": 3}) for i in range(3)]
    slow = [(i * 700, 4624, {"target_username": "bob", "computer": f"H{i}", "logon_type": 3}) for i in range(3)]
    got = bursts.detect(events.frame(hosts + system + slow), "lateral_movement").collect()
    assert [(r.severity, r.description) for r in got] == [
        ("high", "User 'eve' authenticated to 3 distinct hosts within 600s: H0, H1, H2")
    ]


def test_privilege_is_one_alert_per_user(events):
    rows = [
        (0, 4672, {"username": "eve", "raw_json": '{"EventData":{"PrivilegeList":"SeTcbPrivilege"}}'}),
        (9, 4673, {"username": "eve", "raw_json": '{"EventData":{"PrivilegeList":"SeDebugPrivilege"}}'}),
        (0, 4672, {"username": "system", "raw_json": '{"p":"SeDebugPrivilege"}'}),
        (0, 4672, {"username": "bob", "raw_json": '{"p":"SeChangeNotifyPrivilege"}'}),
    ]
    got = bursts.detect(events.frame(rows), "privilege_escalation").collect()
    assert [(r.severity, r.description) for r in got] == [
        ("high", "User 'eve' was assigned sensitive privileges (2 event(s)): SeDebugPrivilege, SeTcbPrivilege")
    ]
    assert got[0].evidence[0].privileges == ["SeTcbPrivilege"]


def test_recon_and_dns(events):
    recon = [(i * 10, 1, {"process_name": f"C:\\x\\{p}.exe", "username": "eve"}) for i, p in enumerate(["whoami", "NET", "arp"])]
    got = bursts.detect(events.frame(recon), "discovery").collect()
    assert [r.description for r in got] == ["User 'eve' ran 3 recon commands (arp, net, whoami) within 120s on WS-PC01"]
    label = "a1b2c3d4e5f6g7h8i9j0k"
    dns = [(i, 22, {"raw_json": '{"QueryName":"%s%d.evil.com"}' % (label, i % 3)}) for i in range(30)]
    plain = [(i, 22, {"raw_json": '{"QueryName":"www.example.com"}', "computer": "B"}) for i in range(30)]
    got = bursts.detect(events.frame(dns + plain), "dns_exfiltration").collect()
    assert [(r.severity, r.description) for r in got] == [
        ("high", "30 high-entropy DNS queries from WS-PC01 in 60s spanning 1 parent domain(s): evil.com")
    ]


def test_attack_chain(events):
    rows = [
        (0, 4625, {"username": "eve"}), (10, 4672, {"username": "eve"}), (20, 4624, {"username": "eve", "logon_type": 3}),
        (30, 1, {"username": "eve", "process_name": "x.exe"}), (0, 4625, {"username": "bob"}), (9000, 4672, {"username": "bob"}),
    ]
    got = bursts.detect(events.frame(rows), "attack_chain").collect()
    assert [(r.severity, r.description, r.evidence_count) for r in got] == [
        ("critical",
         "User 'eve' observed in 4 attack stages within 30s: Credential Access -> Privilege Escalation -> Lateral Movement -> Execution", 4)
    ]


CASES = [
    ([(0, 1102, {})], [("Log Clearing Detected", "high")]),
    ([(0, 5001, {}), (0, 4719, {})], [("Audit Policy Modified", "medium"), ("Windows Defender Disabled", "high")]),
    ([(0, 1, {"command_line": "NETSH advfirewall set x"})], [("Firewall Rule Modification", "medium")]),
    ([(0, 7045, {"raw_json": '{"p":"PowerShell -x"}'})], [("New Service Created", "critical")]),
    ([(0, 7045, {"raw_json": '{"p":"a.exe"}'}), (0, 4698, {})], [("New Service Created", "high"), ("Scheduled Task Created", "high")]),
    ([(0, 13, {"raw_json": r'{"T":"HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\x"}'})], [("Registry Run Key Modified", "high")]),
    ([(0, 11, {"raw_json": r'{"T":"C:\\Startup\\x"}'}), (0, 13, {"raw_json": r'{"T":"C:\\Startup\\x"}'})], [("Startup Folder Modified", "medium")]),
    ([(0, 1, {"command_line": "7z a x.7z c:\\users\\bob"})], [("Suspicious Archive Creation", "high")]),
    ([(0, 1, {"command_line": "zip x c:\\data"})], [("Data Staging Detected", "medium")]),
    ([(0, 4769, {"raw_json": '{"e":"0x17"}', "target_username": "svc"})], [("Potential Kerberoasting", "high")]),
    ([(0, 4769, {"raw_json": '{"e":"0x17"}', "target_username": "HOST$"})], []),
    ([(0, 4768, {"raw_json": '{"e":"0x17"}', "target_username": "bob"})], [("Potential AS-REP Roasting", "high")]),
    ([(0, 4624, {"logon_type": 10, "source_ip": "185.1.2.3"}), (0, 4624, {"logon_type": 10, "source_ip": "10.0.0.1"})], [("External RDP Logon", "high")]),
    ([(-3600 * 3, 4624, {}), (0, 4624, {}), (3600 * 12, 4624, {"username": "system"})], [("After-Hours Logon", "low")]),
    ([(0, 10, {"raw_json": r'{"EventData":{"TargetImage":"C:\\W\\LSASS.exe"}}'})], [("LSASS Memory Access", "critical")]),
    ([(0, 4663, {"raw_json": r'{"ObjectName":"\\REGISTRY\\MACHINE\\SAM"}'})], [("SAM Hive Access", "critical")]),
    ([(0, 1, {"process_name": "C:\\w\\PowerShell.exe", "command_line": "powershell -enc " + "A" * 24})], [("Suspicious Process: Base64-encoded PowerShell command", "high")]),
    ([(0, 1, {"process_name": "whoami.exe", "command_line": "whoami /priv"})], []),
    ([(0, 1, {"process_name": "cmd.exe", "command_line": "reg save HKLM\\SAM x"})], [("Suspicious Process: SAM registry hive access", "critical")]),
]


@pytest.mark.parametrize("rows,want", CASES)
def test_single_event_detectors(events, rows, want):
    assert single(events, rows) == want


def test_replication_needs_given_guids(events):
    rows = [(0, 4662, {"raw_json": '{"P":"{AAAA-1}"}'})]
    assert single(events, rows) == []
    assert single(events, rows, replication_guids=("aaaa-1",)) == [("Directory Replication Request", "critical")]


def test_scan_excludes_skips_and_allows(spark, events):
    def own(e, s):
        return run_row_rules(e, [r for r in stateless_rules(s, ["defense_evasion"])]).withColumn("detector", F.lit("own"))

    def broken(e, s):
        return e.select("no_such_column")

    rows = fails(12, computer="H1") + [(0, 1102, {}), (20, 1, {"username": "zoe", "process_name": "a"})]
    rows[11] = (55, 4625, {"source_ip": "10.0.1.50", "username": "zed", "computer": "HIDDEN"})
    allow = ({"computer": "hidden", "reason": "lab"},)
    config = ScanConfig(
        exclude=("Chain", "initial_access"), detectors=(("own", own), ("broken", broken)), allowlist=allow,
        field_rules=({"name": "procs", "description": "p", "conditions": [{"field": "event_id", "value": 1}]},
                     {"name": "many", "description": "m", "conditions": [], "threshold": 3}),
        sigma_rules=({"title": "s", "detection": {"selection": {"EventID": 1102}}}, {"title": "bad", "detection": {"a": {}, "condition": "a and"}}),
    )
    found = all_alerts(events.frame(rows), config)
    got = sorted((r.detector, r.evidence_count) for r in found.collect())
    assert got == [("brute_force", 12), ("defense_evasion", 1), ("own", 1), ("rule:many", 14), ("rule:procs", 1), ("sigma:s", 1)]
    # The host is only in the eleventh evidence row, which the alert does not show.
    kept, dropped = scan_alerts(events.frame(rows), config)
    assert sorted(r.detector for r in dropped.collect()) == ["brute_force", "rule:many"]
    assert kept.count() == 4
    assert run_detections(events.frame(rows), config).count() == 4
    severe = run_detections(events.frame(rows), dataclasses.replace(config, min_severity="high"))
    assert all(r.severity in ("high", "critical") for r in severe.collect()) and severe.count() < 4
    assert watch_values(allow) == {"computer": ["hidden"]}


def test_hot_key_is_split_over_tasks(spark, events, monkeypatch):
    """One source with nearly all events: no task may get more than its cell of rows."""
    from emberwatch.operators import windows

    monkeypatch.setattr(windows, "CELL_ROWS", 200)
    rows = events.frame([(i * 30, 4625, {"source_ip": "6.6.6.6", "username": "u"}) for i in range(3000)])
    instants = windows.keyed(rows, "source_ip", 300, 5)
    cells, n_cells = windows._in_cells(windows._with_ends(instants), 6000, windows.ORDER, "cells")
    sizes = cells.groupBy("rule", "key", "cell").count()
    assert n_cells == 30 == sizes.count() and sizes.agg(F.max("count")).first()[0] <= 2 * 200
    got = bursts.detect(rows, "brute_force").collect()
    assert len(got) == 273 and {r.evidence_count for r in got} == {11, 8}


def test_own_python_detectors(spark, events):
    import pandas as pd

    def finding(e, name, n):
        return {"rule_name": name, "severity": "low", "description": f"{name} {n}", "alert_ts": e.event_ts, "mitre_tactic": "",
                "mitre_technique": "", "recommendation": "", "evidence_count": n, "username": e.username, "computer": e.computer, "source_ip": ""}

    columns = list(finding(pd.Series({"event_ts": 0, "username": 0, "computer": 0}), "x", 0))

    def batch(pdf):
        return pd.DataFrame([finding(e, "odd", 1) for e in pdf.itertuples() if e.event_id % 2], columns=columns)

    def window(pdf):
        return pd.DataFrame([finding(pdf.iloc[0], "pair", len(pdf))] if len(pdf) > 1 else [], columns=columns)

    rows = events.frame([(0, 1, {}), (5, 2, {}), (900, 3, {})])
    needed = ["event_ts", "event_id", "username", "computer"]
    s = DetectorSettings()
    assert batch_detector("b", batch, needed)(rows, s).count() == 2
    got = window_detector("w", window, "username", needed, 60)(rows, s).collect()
    assert [(r.rule_name, r.evidence_count, r.evidence[0].username) for r in got] == [("pair", 2, "jdoe")]
    assert detector_catalog(spark).count() == 13


def test_sequence_detector_gets_a_long_window_in_parts(spark):
    """One window of 300,000 events comes in order and in batches, none of which holds the group."""
    from emberwatch.operators.settings import DetectorSettings
    from emberwatch.plans.registry import Sequence, sequence_detector

    class Order(Sequence):
        def __init__(self):
            self.n, self.largest, self.last, self.sorted = 0, 0, None, True

        def add(self, events):
            t = events["event_ts"]
            self.sorted &= t.is_monotonic_increasing and (self.last is None or t.iloc[0] >= self.last)
            self.n, self.largest, self.last = self.n + len(t), max(self.largest, len(t)), t.iloc[-1]

        def finding(self):
            return {"rule_name": "r", "severity": "low", "description": f"{self.sorted} {self.largest <= 10_000}", "alert_ts": self.last, "mitre_tactic": "",
                    "mitre_technique": "", "recommendation": "", "evidence_count": self.n, "username": "u", "computer": "", "source_ip": ""}

    at = "timestamp_ntz '2024-01-15 00:00:00' + make_dt_interval(0, 0, 0, cast(pmod(id * 7919, 300000) / 1000.0 as decimal(18, 6)))"
    frame = spark.range(300_000).selectExpr("cast(id as string) AS event_uid", f"{at} AS event_ts", "'u' AS username")
    found = sequence_detector("order", Order, "username", ["event_ts"], 3600)(frame, DetectorSettings()).collect()
    assert [(r.description, r.evidence_count) for r in found] == [("True True", 300_000)]
