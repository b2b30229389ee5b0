from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timedelta

import pytest
from conftest import START
from pyspark.sql import functions as F

from emberwatch.operators import correlate, hashchain, post, rowrules
from emberwatch.operators.fieldrules import OPERATORS, FieldRule, conditions_test, event_field
from emberwatch.operators.ruleindex import Literal, RuleIndex, of_condition
from emberwatch.operators.sigma import detect_sigma, merge_selections, sigma_row_rule
from emberwatch.plans import payloads, reports
from emberwatch.schema import ALERT_COLUMNS, EVIDENCE_DDL, evidence_struct, finish_alerts
from emberwatch.sources import store


@pytest.fixture(scope="module")
def three(events):
    return events.frame([
        (0, 1, {"command_line": "powershell -Enc x", "process_name": "C:\\W\\PowerShell.exe", "raw_json": '{"A":{"b":5},"EventData":{"K":"v"}}'}),
        (1, 4625, {"username": "", "target_username": "Ann", "raw_json": '{"EventData":{"K":"100%\\nnext"}}'}),
        (2, 4624, {"logon_type": 10, "computer": "ÉCOLE"}),
    ]).cache()


def ids(df):
    return sorted(r.event_id for r in df.collect())


CONDITIONS = [
    ([("command_line", "contains", "POWERSHELL")], [1]),
    ([("command_line", "not_contains", "power")], [4624, 4625]),
    ([("process_name", "endswith", "shell.EXE"), ("process_name", "startswith", "c:\\w")], [1]),
    ([("target_username", "equals", "ann")], [4625]),
    ([("target_username", "not_equals", "")], [4625]),
    ([("command_line", "regex", r"\s-enc\b")], [1]),
    ([("logon_type", "gt", 9), ("logon_type", "lte", "10")], [4624]),
    ([("event_id", "lt", 4625), ("event_id", "gte", 4624)], [4624]),
    ([("command_line", "gt", -1)], [1, 4624, 4625]),
    ([("event_id", "in", ["1", 4624])], [1, 4624]),
    ([("raw.A.b", "equals", 5)], [1]),
    ([("K", "equals", "V")], [1]),
    ([("missing", "equals", "")], [1, 4624, 4625]),
    ([("event_id", "no_such", 1)], [1, 4624, 4625]),
    ([], [1, 4624, 4625]),
]


@pytest.mark.parametrize("conditions,want", CONDITIONS)
def test_conditions(three, conditions, want):
    rule = [dict(zip(("field", "operator", "value"), c)) for c in conditions]
    assert ids(three.where(conditions_test(rule))) == want


def test_rule_definitions(three):
    assert len(OPERATORS) == 12
    with pytest.raises(ValueError):
        FieldRule.of({"name": "x", "severity": "awful"})
    assert FieldRule.of({}).per_event and not FieldRule.of({"threshold": 2}).per_event
    assert three.where("event_id = 1").select(event_field("timestamp")).first()[0] == "2024-01-15 08:30:00"


SIGMA = [
    ({"selection": {"CommandLine|contains": ["nope", "-enc"]}}, [1]),
    ({"selection": {"Image|endswith": "\\powershell.exe"}, "filter": {"EventID": 1}, "condition": "selection and not filter"}, []),
    ({"a": {"EventID": "4625"}, "b": {"EventID": 4624}, "condition": "a or b"}, [4624, 4625]),
    ({"s1": {"EventID": 1}, "s2": {"EventID": 4624}, "condition": "1 of s*"}, [1, 4624]),
    ({"s1": {"EventID": 1}, "s2": {"LogonType": 0}, "condition": "all of them"}, [1]),
    ({"s1": {"EventID": 1}, "condition": "1 of nothing*"}, []),
    ({"s": {"K": "100%*"}, "condition": "s"}, []),  # * does not cross a line end
    ({"s": {"K|re": "^100%"}, "condition": "s"}, [4625]),
    ({"s": {"Computer": "école"}, "condition": "s"}, [4624]),
    ({"s": {"Image": "*\\power*.EXE"}, "condition": "(s)"}, [1]),
    ({"s": {"CommandLine|contains|all": ["power", "nope"]}, "condition": "s"}, [1]),
    ({"s": {"CommandLine|all": ["power*", "*x"]}, "condition": "s"}, [1]),
    ({"s": [{"EventID": 1}, {"EventID": 4624}], "condition": "s"}, [1, 4624]),
    ({"s": [{"EventID": 1}, {"LogonType": 10}], "condition": "s"}, []),
    ({"a": {"EventID": 1}, "b": {"EventID": 4625}, "c": {"EventID": 9}, "condition": "a or b and c"}, [1]),
    ({"a": {"EventID": 1}, "condition": "NOT a"}, [4624, 4625]),
]


@pytest.mark.parametrize("detection,want", SIGMA)
def test_sigma(three, detection, want):
    got = detect_sigma(three, [{"title": "t", "detection": detection}])
    assert sorted(r.evidence[0].event_id for r in got.collect()) == want


def test_sigma_labels(three):
    rule = {
        "title": "T", "description": "D", "level": "informational", "tags": ["attack.command_and_control", "attack.t1059.001"],
        "falsepositives": ["Admins"], "logsource": {"category": "process_creation"}, "detection": {"selection": {"LogonType": 0}},
    }
    r = detect_sigma(three, [rule]).collect()
    assert len(r) == 1
    assert (r[0].rule_name, r[0].severity, r[0].description, r[0].mitre_tactic, r[0].mitre_technique, r[0].recommendation) == (
        "Sigma: T", "info", "D", "Command And Control", "T1059.001", "Possible false positive: Admins",
    )
    assert merge_selections([{"a": 1}, {"a": [2, 3]}, {"b": 4}]) == {"a": [1, 2, 3], "b": 4}
    spec = [{"title": "s", "detection": {"selection": {"CommandLine|contains|all": ["power", "nope"]}}}]
    assert detect_sigma(three, spec, spec_all=True).count() == 0
    many = [{"title": f"r{i}", "detection": {"selection": {"EventID": 1, "CommandLine|contains": f"{i % 7}x"}}} for i in range(250)]
    assert detect_sigma(three, many).count() == 0


def _many_rules(n):
    out = []
    for k in range(n):
        selections = [
            {"selection": {"CommandLine|contains": f"tool{k % 97}x"}},
            {"selection": {"EventID": 4000 + k, "User": f"User{k % 13}"}},
            {"selection": {"Image": f"*\\\\app{k}.exe"}, "other": {"EventID": [k, k + 1]}, "condition": "selection or other"},
            {"selection": {"EventID": k}, "no": {"User|startswith": "user1"}, "condition": "selection and not no"},
            {"selection": {"CommandLine|re": f"tool{k}x+$"}},
        ]
        out.append({"title": f"r{k}", "detection": selections[k % 5]})
    return out


def test_rule_index_gives_what_all_rules_give(spark, events, monkeypatch):
    rows = [(k, k * 7 % 300, {"command_line": f"run TOOL{k % 120}xx", "username": f"user{k % 17}", "process_name": f"C:\\app{k}.exe"}) for k in range(200)]
    rows += [(k, 4000 + k, {"username": f"USER{k % 13}"}) for k in range(300)]
    frame, rules = events.frame(rows), [sigma_row_rule(r, k) for k, r in enumerate(_many_rules(300))]
    columns = ["rule_name", "alert_ts", "evidence"]
    got = sorted(map(str, rowrules.run_row_rules(frame, rules).select(columns).collect()))
    monkeypatch.setattr(rowrules, "RULES_PER_ARRAY", 1000)
    assert got == sorted(map(str, rowrules.run_row_rules(frame, rules).select(columns).collect())) and len(got) > 300


def test_rule_index_reads_the_events_once(spark, events):
    """Whatever the number of rules: one scan finds the candidates, and an event costs its own tokens."""
    frame = events.frame([(0, 1, {"command_line": "tool5x"})])
    for n in (150, 600):
        rules = [sigma_row_rule({"title": f"r{k}", "detection": {"selection": {"CommandLine|contains": f"tool{k}x"}}}, k) for k in range(n)]
        index = RuleIndex([[r.literals for r in rules[k : k + 100]] for k in range(0, n, 100)])
        assert spark.sql("SELECT 'tool5x' AS command_line").selectExpr(f"size({index.event_tokens()}) AS n").first().n <= 2 + 4
        assert [r.rule_name for r in rowrules.run_row_rules(frame, rules).collect()] == ["Sigma: r5"]


def test_raw_records_are_parsed_once_per_pass(spark, three, tmp_path):
    """Three rules over five raw fields: one parse in the plan, none if the landed table has the parsed record."""
    rules = [{"title": f"s{k}", "detection": {"selection": {f"K{k}": "v", "K": "v"}, "other": {"A.b": 5, "K": "v"}, "condition": "selection or other"}} for k in range(3)]

    def parses(df):
        spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        spark.conf.unset("spark.sql.debug.maxToStringFields")
        return plan.lower().replace("_", "").count("parsejson")

    found = detect_sigma(three, rules)
    assert parses(found) == 1
    store.write_events(three, str(tmp_path / "e"), parsed=True)
    landed = detect_sigma(store.read_events(spark, str(tmp_path / "e")), rules)
    assert parses(landed) == 0
    assert sorted(r.rule_name for r in landed.collect()) == sorted(r.rule_name for r in found.collect())
    many = [{"title": f"m{k}", "detection": {"selection": {"K": f"w{k}" if k else "v"}}} for k in range(150)]
    assert [r.rule_name for r in detect_sigma(three, many).collect()] == ["Sigma: m0"]


def test_texts_of_conditions():
    a, b = frozenset([Literal("f", "aaa")]), frozenset([Literal("f", "bbbb"), Literal("f", "cc")])
    values = {"s_a": a, "s_b": b, "s_n": None}
    for sql, want in (("(`s_a` AND `s_b`)", a), ("(`s_a` OR `s_b`)", a | b), ("(`s_n` OR `s_b`)", None), ("(`s_n` AND NOT `s_a`)", None), ("(`s_b` AND NOT `s_n`)", b), ("(false)", frozenset())):
        assert of_condition(sql, values) == want


@pytest.fixture(scope="module")
def alerts(spark):
    rows = [
        # rule, severity, seconds, tactic, technique, computer, username, ip
        ("Odd PowerShell", "high", 0, "Execution", "T1059.001 - P", "H1", "Eve", "1.1.1.1"),
        ("Odd PowerShell", "high", 0, "Execution", "T1059.001 - P", "h1", "bob", ""),
        ("New Service", "critical", 1800, "Persistence", "T1543 - S", "H1", "", ""),
        ("Late", "low", 3601, "Initial Access", "T1078 - V", "H1", "eve", "1.1.1.1"),
        ("Plain", "info", 9000, "", "", "", "", ""),
    ]
    df = spark.createDataFrame(
        [(r, s, START + timedelta(seconds=t), a, b, c, u, i, f"d{n}") for n, (r, s, t, a, b, c, u, i) in enumerate(rows)],
        "rule_name string, severity string, alert_ts timestamp_ntz, mitre_tactic string, mitre_technique string, c string, u string, i string, description string",
    )
    evidence = F.array(evidence_struct(computer="c", username="u", source_ip="i", event_id="7"))
    return finish_alerts(
        df.withColumns({"detector": F.lit("d"), "recommendation": F.lit(""), "evidence_count": F.lit(1), "evidence": evidence})
    ).cache()


def test_incidents(alerts):
    got = correlate.rank_incidents(correlate.correlate_alerts(alerts)).collect()
    assert [(r.title, r.alert_count, r.risk_score, r.stages, r.mitre_tactics) for r in got] == [
        ("Correlated Host Incident: h1", 3, 100, ["PowerShell Execution", "Persistence Event"], ["Execution", "Persistence"])
    ]
    wide = {r.entity: r.risk_score for r in correlate.correlate_alerts(alerts, window_minutes=120).collect()}
    assert wide == {"h1": 100, "eve": 55, "1.1.1.1": 55}


ALLOW = [
    ([{"rule_name": "powershell", "username": "EVE"}], 1), ([{"computer": "h1"}], 4), ([{"source_ip": "1.1.1.1", "severity": "LOW"}], 1),
    ([{"event_id": "7"}], 5), ([{"mitre_technique": "t1543"}], 1), ([{}], 5), ([{"event_id": 8}], 0), ([], 0),
]


@pytest.mark.parametrize("allow,dropped", ALLOW)
def test_allowlist(alerts, allow, dropped):
    kept, out = post.apply_allowlist(alerts, allow)
    assert (kept.count(), out.count()) == (5 - dropped, dropped)


def test_first_allowlist_entry_gives_the_reason(alerts):
    _, out = post.apply_allowlist(alerts, [{"severity": "critical", "reason": "a"}, {"computer": "H1", "reason": None}])
    assert sorted((r.reason, r.n) for r in post.suppression_stats(out).collect()) == [("a", 1), ("allowlisted", 3)]


def test_ranking_gate_and_dedup(alerts):
    assert [r.severity for r in post.rank_alerts(alerts).collect()] == ["critical", "high", "high", "low", "info"]
    assert post.any_at_least(alerts, "critical").first()[0] and not post.any_at_least(alerts.where("severity = 'low'"), "high").first()[0]
    assert not post.any_at_least(alerts.limit(0), "info").first()[0]
    assert post.dedup_alerts(alerts).count() == 4 and post.dedup_alerts(alerts).columns == ALERT_COLUMNS
    assert post.facet_filter(alerts, severities=["info"], tactics=["Execution"]).count() == 1  # no tactic passes
    assert post.facet_filter(alerts, hosts=["h1"]).count() == 1


def test_reports(alerts, spark, tmp_path):
    assert [(r.severity, r.n) for r in reports.severity_summary(alerts).collect()] == [("info", 1), ("low", 1), ("medium", 0), ("high", 2), ("critical", 1)]
    assert reports.top_rules(alerts).first().rule_name == "Odd PowerShell"
    layer = {r.technique_id: r for r in reports.technique_layer(alerts).collect()}
    assert layer["T1059.001"].is_subtechnique and layer["T1059.001"].max_score == 2
    assert layer["T1543"].comment == "1 alert(s) across 1 rule(s): New Service. Severities: critical."
    line = reports.timeline(alerts).orderBy("offset_seconds").collect()
    assert line[0].fraction == 0 and line[-1].fraction == 1
    assert reports.timeline(alerts.where("severity = 'low'")).first().fraction == 0
    assert reports.timeline_ticks(alerts).count() == 6
    payloads.write_csv_report(alerts, 9, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/alerts")).count() == 5
    payloads.write_json_report(alerts, 9, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/metadata")).first().total_alerts == 5
    assert spark.read.json(str(tmp_path / "json/alerts")).where("evidence_count = 1").count() == 5
    ids = payloads.intel_objects(alerts).select("id").distinct()
    assert ids.count() == 10


def test_store(alerts, spark, tmp_path):
    folder = str(tmp_path / "store")
    store.save_alerts(alerts, folder)
    store.save_incidents(correlate.correlate_alerts(alerts), folder)
    store.save_report(spark, folder, "pdf", "/x", F.lit("{}"))
    assert store.scan_table(spark, f"{folder}/alerts", ["alert_ts", "alert_id"], limit=2).count() == 2
    assert spark.read.parquet(f"{folder}/mitre_mappings").count() == 4
    assert spark.read.parquet(f"{folder}/incidents").count() == 1 and spark.read.parquet(f"{folder}/reports").count() == 1


def test_chain_detects_changes_and_cuts(events, spark):
    first = events.frame([(i, 1, {}) for i in range(40)])
    records = store.materialize(hashchain.append_chain(first, segment_size=10), "chain")
    assert records.count() == 40 and records.select("shard").distinct().count() == 4
    assert hashchain.verify_chain(records).count() == 0
    heads = hashchain.chain_heads(records)
    more = hashchain.append_chain(events.frame([(100 + i, 1, {}) for i in range(40)]), heads=heads, segment_size=10)
    both = store.materialize(records.unionByName(more), "chain2")
    assert hashchain.verify_chain(both).count() == 0 and both.agg(F.max("seq")).first()[0] > 15
    changed = records.withColumn("event_hash", F.when((F.col("shard") == 0) & (F.col("seq") == 2), "0").otherwise(F.col("event_hash")))
    bad = hashchain.verify_chain(changed).orderBy("seq").collect()
    assert [(r.seq, r.hash_mismatch, r.link_mismatch) for r in bad] == [(2, True, False), (3, True, True)]
    cut = records.join(heads.select("chain_id", "day", "shard", "seq"), ["chain_id", "day", "shard", "seq"], "left_anti")
    assert hashchain.verify_chain(cut).count() == 0
    assert hashchain.verify_heads(cut, heads).count() == 4 and hashchain.verify_heads(records, heads).count() == 0


def test_ids_of_intel_objects_are_made_once(spark):
    rows = [("a1", "R", "low", "d", datetime(2024, 1, 1), "T", "T1", "", 1)]
    made = spark.createDataFrame(rows, "alert_id string, rule_name string, severity string, description string, alert_ts timestamp_ntz, "
                                 "mitre_tactic string, mitre_technique string, recommendation string, evidence_count bigint")
    made = made.selectExpr("*", f"cast(array() as array<{EVIDENCE_DDL}>) AS evidence")
    objects = payloads.intel_objects(made)
    assert objects._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 2
    found = {r.kind: (r.id, json.loads(r.value)) for r in objects.collect()}
    seed = f"R|2024-01-01T00:00:00|T1|{hashlib.sha256(b'd').hexdigest()[:16]}"
    assert found["indicator"][0] == f"indicator--{uuid.uuid5(payloads.NAMESPACE, seed)}" == found["sighting"][1]["sighting_of_ref"]
    assert found["sighting"][0] == f"sighting--{uuid.uuid5(payloads.NAMESPACE, seed + '|sighting')}" == found["sighting"][1]["id"]
