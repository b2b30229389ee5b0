from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberwatch.sources import store
from emberwatch.sources.event_xml import read_event_xml
from emberwatch.sources.json_logs import read_json_logs
from emberwatch.sources.lines import discover_logs, read_lines
from emberwatch.sources.logs import read_logs
from emberwatch.sources.siem_export import newer_than, read_siem_export
from emberwatch.sources.syslog import match_lines, read_cef, read_syslog

RECORD = {
    "TimeCreated": "2024-01-15T08:30:01Z", "EventID": 4625, "Source": "Auditing", "Computer": "WS-PC01",
    "EventData": {"TargetUserName": "admin", "IpAddress": "10.0.1.50", "LogonType": 3, "Status": "0xC000006D"},
}
ALIASES = {"@timestamp": "2024-01-15 08:31:00", "event_id": "1", "src_ip": "1.2.3.4", "process": "cmd.exe", "command_line": "cmd /c x", "username": "bob"}


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return df.orderBy("event_uid").collect()


def test_json_lines_with_bad_lines(spark, tmp_path):
    path = put(tmp_path, "a.ndjson", "\n".join([
        json.dumps(RECORD), "", "{broken", json.dumps({**RECORD, "EventID": "abc"}), "[1, 2]x", json.dumps(ALIASES), '"text"',
    ]))
    events, bad = read_json_logs(spark, path, layout="lines")
    got = rows(events)
    assert [(r.event_id, r.category, r.target_username, r.source_ip, r.logon_type, r.username) for r in got] == [
        (4625, "authentication", "admin", "10.0.1.50", 3, ""), (1, "process", "", "1.2.3.4", 0, "bob"),
    ]
    assert got[0].event_ts == datetime(2024, 1, 15, 8, 30, 1) and got[0].status == "0xC000006D"
    assert sorted(r.reason for r in bad.collect()) == ["bad number", "malformed", "malformed", "malformed"]


def test_json_array_and_lines_in_one_folder(spark, tmp_path):
    put(tmp_path, "a.json", "\n  " + json.dumps([RECORD, {**RECORD, "TimeCreated": "??"}], indent=2))
    put(tmp_path, "b.json", json.dumps(ALIASES) + "\n")
    events, bad = read_json_logs(spark, str(tmp_path))
    got = events.orderBy("event_ts").collect()
    assert [r.event_id for r in got] == [4625, 4625, 1]
    assert got[0].event_ts == datetime(1, 1, 1) and not got[0].ts_valid and got[1].ts_valid
    assert bad.count() == 0


SYSLOG = """<34>Jan 15 08:30:01 server01 sshd[1234]: Failed password for admin from 10.0.1.50 port 22 ssh2
<34>1 2026-05-13T08:30:01.001Z gateway sshd 4567 - failed password for invalid user admin from 198.51.100.5 port 41522 ssh2
Jan  5 08:30:01 host2 cron: session opened for user bob
CEF:0|V|P|1.0|100|Login|5|src=1.2.3.4 duser=amy
not a log line
<86>Foo 15 08:30:01 server01 app: tcp listen
"""


def test_syslog(spark, tmp_path):
    events, bad = read_syslog(spark, put(tmp_path, "s.log", SYSLOG), default_year=2024)
    got = {r.raw_json.split('"format":"')[1].split('"')[0] + r.computer: r for r in events.collect()}
    a, b, c, d = got["rfc3164server01"], got["rfc5424gateway"], got["rfc3164host2"], got["cef"]
    ok = [r for r in events.collect() if r.source == "sshd" and r.computer == "server01"][0]
    assert (ok.event_ts, ok.event_id, ok.username, ok.source_ip, ok.category) == (
        datetime(2024, 1, 15, 8, 30, 1), 4625, "admin", "10.0.1.50", "authentication",
    )
    assert a.computer == "server01"
    assert (b.event_ts, b.event_id, b.username, b.process_name) == (datetime(2026, 5, 13, 8, 30, 1, 1000), 4625, "admin", "sshd")
    assert (c.event_id, c.username, c.event_ts) == (4624, "bob", datetime(2024, 1, 5, 8, 30, 1))
    assert (d.event_id, d.target_username, d.source_ip, d.category) == (100, "amy", "1.2.3.4", "network")
    unknown_month = [r for r in events.collect() if r.source == "app"][0]
    assert not unknown_month.ts_valid and unknown_month.event_id == 86
    assert [r.value for r in bad.collect()] == ["not a log line"]


def test_cef(spark, tmp_path):
    long_value = "x" * 200_000
    lines = [
        r"Jan 15 08:30:01 fw01 CEF:0|Ven|Prod|1.0|abc|Conn name|7|src=10.0.0.1 msg=a\=b c\\d suser=eve act=blocked it",
        "CEF:0|Ven|Prod|1.0|42|Named|10|rt=1705307401500 dhost=h1 sourceAddress=9.9.9.9 sproc=p.exe",
        f"CEF:0|V|P|1|1|n|0|cs1={long_value} dntdom=D src=1.1.1.1 src=2.2.2.2",
        "CEF:0|too|few",
    ]
    events, bad = read_cef(spark, put(tmp_path, "c.cef", "\n".join(lines)), default_year=2024)
    a, b, c = rows(events)
    assert (a.event_id, a.computer, a.event_ts, a.username, a.command_line, a.category, a.source) == (
        0, "15", datetime(2024, 1, 15, 8, 30, 1), "eve", "blocked it", "privilege", "Ven/Prod",
    )
    assert json.loads(a.raw_json)["extension"]["msg"] == "a=b c\\d"
    assert (b.event_id, b.computer, b.event_ts, b.source_ip, b.process_name, b.command_line) == (
        42, "h1", datetime(2024, 1, 15, 8, 30, 1, 500000), "9.9.9.9", "p.exe", "Named",
    )
    assert c.command_line == long_value and c.domain == "D" and c.source_ip == "2.2.2.2"
    assert bad.count() == 1


XML = """<?xml version="1.0"?><Events>
<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Sec"/>
<EventID Qualifiers="0">4624</EventID><TimeCreated SystemTime="2024-01-15T08:30:01.1234567Z"/><Computer>H1</Computer>
<Channel>Security</Channel></System><EventData><Data Name="TargetUserName">amy</Data><Data Name="LogonType">10</Data>
<Data>unnamed</Data><Data Name="IpAddress"/></EventData></Event>
<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Log"/><EventID>1102</EventID>
<TimeCreated SystemTime="2024-01-15T08:31:00Z"/><Computer>H2</Computer></System><UserData><LogFileCleared>
<SubjectUserName>root</SubjectUserName></LogFileCleared></UserData></Event>
<Event><System><EventID>4624</EventID></System><EventData><Data Name="LogonType">odd</Data></EventData></Event>
</Events>"""


def test_event_xml(spark, tmp_path):
    events, bad = read_event_xml(spark, put(tmp_path, "e.xml", XML))
    a, b = rows(events)
    assert (a.event_id, a.source, a.computer, a.target_username, a.logon_type, a.source_ip, a.category) == (
        4624, "Sec", "H1", "amy", 10, "", "authentication",
    )
    assert a.event_ts == datetime(2024, 1, 15, 8, 30, 1, 123456)
    assert json.loads(a.raw_json)["EventData"]["TargetUserName"] == "amy"
    assert (b.event_id, b.username, b.computer) == (1102, "root", "H2")
    assert [r.reason for r in bad.collect()] == ["bad number"]


def test_event_xml_lines(spark, tmp_path):
    one = '<Event><System><EventID>{}</EventID><Computer>H</Computer></System><EventData><Data Name="User">u</Data></EventData></Event>'
    text = "\n".join(["<Events>", one.format(4624), one.format(1102), "<Event><System><EventID>", "</Events>"])
    events, bad = read_event_xml(spark, put(tmp_path, "l.xml", text), layout="lines")
    assert [(r.event_id, r.username) for r in rows(events)] == [(4624, "u"), (1102, "u")]
    assert [r.reason for r in bad.collect()] == ["malformed"]


SIEM = {
    "timestamp": "2024-01-15T08:30:01.123+0000", "id": "5", "location": "/var/log/auth",
    "agent": {"id": "001", "name": "web1"},
    "rule": {"id": 4625, "level": 12, "description": "many failures", "groups": ["auth", "x"], "mitre": {"id": ["T1110"], "tactic": ["Credential Access"]}},
    "data": {"srcip": "1.2.3.4", "win": {"eventdata": {"TargetUserName": "amy", "LogonType": 3}}},
}


@pytest.mark.parametrize(
    "payload",
    [[SIEM, 3], {"data": {"affected_items": [SIEM]}}, {"items": [SIEM, "x"]}, {"data": {"one": SIEM}}],
)
def test_siem_export(spark, tmp_path, payload):
    got = read_siem_export(spark, put(tmp_path, "w.json", json.dumps(payload, indent=1)))[0].collect()
    assert len(got) == 1
    r = got[0]
    assert (r.event_id, r.computer, r.agent_id, r.username, r.target_username, r.source_ip, r.logon_type) == (
        4625, "web1", "001", "amy", "amy", "1.2.3.4", 3,
    )
    assert (r.mitre_tactic, r.mitre_technique, r.event_source, r.process_name, r.category) == (
        "Credential Access", "T1110", "many failures", "auth", "process",
    )
    assert r.event_ts == datetime(2024, 1, 15, 8, 30, 1, 123000)


def test_siem_export_lines(spark, tmp_path):
    text = "\n".join(json.dumps({"items": [SIEM, SIEM]}) for _ in range(3)) + "\n{broken\n"
    assert read_siem_export(spark, put(tmp_path, "w.jsonl", text), layout="lines")[0].count() == 6


def test_siem_export_without_alerts(spark, tmp_path):
    events, bad = read_siem_export(spark, put(tmp_path, "w.json", json.dumps({"error": 0})))
    assert events.count() == 0 and [r.reason for r in bad.collect()] == ["no alerts"]
    ids = spark.createDataFrame([("4",), ("5",), ("11",)], "id string")
    assert sorted(r.id for r in newer_than(ids, 4).collect()) == ["11", "5"]


def test_discovery_and_mixed_folder(spark, tmp_path):
    put(tmp_path, "a.ndjson", json.dumps(RECORD))
    put(tmp_path, "b.log", SYSLOG)
    put(tmp_path, "c.cef", "CEF:0|V|P|1|1|n|0|src=1.1.1.1")
    put(tmp_path, "d.xml", XML)
    put(tmp_path, "e.txt", "ignored")
    sub = tmp_path / "sub"
    sub.mkdir()
    put(sub, "f.JSONL".lower(), json.dumps(ALIASES))
    found = {r.src_file.rsplit("/", 1)[1]: r.src_format for r in discover_logs(spark, str(tmp_path)).collect()}
    assert found == {"a.ndjson": "json", "b.log": "syslog", "c.cef": "cef", "d.xml": "event_xml"}
    assert discover_logs(spark, str(tmp_path), recursive=True).count() == 5
    events, bad = read_logs(spark, str(tmp_path), 2024)
    assert events.count() == 1 + 5 + 1 + 2
    assert bad.count() == 2
    assert read_logs(spark, str(tmp_path), 2024, recursive=True)[0].count() == 10


def test_event_table_prunes_days(spark, events, tmp_path):
    path = str(tmp_path / "ev")
    store.write_events(events.frame([(0, 1, {}), (86400, 1, {}), (2 * 86400, 1, {})]), path)
    assert store.read_events(spark, path).count() == 3
    day = store.read_events(spark, path, since="2024-01-16", until="2024-01-16")
    assert day.count() == 1
    assert "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )


def test_materialize_uses_the_shared_folder(spark):
    df = store.materialize(spark.range(5).select(F.col("id") * 2), "t")
    assert df.count() == 5
    assert store.shared_folder(spark) in df.inputFiles()[0]


def test_auto_layout_looks_at_the_first_character_of_each_file(spark, tmp_path):
    lines = "\n".join(json.dumps({"EventID": k}) for k in range(99)) + "\n[truncated"
    (tmp_path / "lines.json").write_text(lines)
    (tmp_path / "array.json").write_text("\n  [" + ",".join(json.dumps({"EventID": k}) for k in range(5)) + "]")
    (tmp_path / "broken.json").write_text('[{"EventID": 1}, {"Ev')
    events, bad = read_json_logs(spark, str(tmp_path))
    assert events.count() == 104
    assert sorted(r.value.rsplit("/", 1)[-1] for r in bad.collect()) == ["[truncated", "broken.json"]


@pytest.fixture
def small_splits(spark):
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield cut
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def test_long_arrays_are_cut_over_tasks(spark, tmp_path, small_splits):
    """An array over many byte ranges gives the rows of the same data as lines, with the same numbers for any split."""
    odd = ['a"b', "x\\", "[{", "}]", ",", "é\n", '\\"', "{" * 3, ""]
    rows = [{"EventID": k, "Source": odd[k % 9] + "}" * (k % 3), "EventData": {"a": [k, {"b": "]"}], "c": odd[(k + 4) % 9]}} for k in range(3000)]
    (tmp_path / "a").mkdir()
    (tmp_path / "l").mkdir()
    (tmp_path / "a" / "one.json").write_text("\ufeff [\n" + ",\n ".join(map(json.dumps, rows)) + "\n]\n")
    (tmp_path / "a" / "two.json").write_text("[" + json.dumps(rows[3]) + "]")
    (tmp_path / "a" / "none.json").write_text(" [ ] ")
    (tmp_path / "l" / "one.json").write_text("\n".join(map(json.dumps, rows + [rows[3]])))
    want = sorted((r.event_id, r.source) for r in read_json_logs(spark, str(tmp_path / "l"))[0].collect())
    seen = []
    for size in (3_000, 20_000, 1 << 27):
        small_splits(size)
        for layout in ("auto", "array"):
            events, bad = read_json_logs(spark, str(tmp_path / "a"), layout=layout)
            got = events.select("event_id", "source", "event_uid").collect()
            assert sorted((r.event_id, r.source) for r in got) == want and bad.count() == 0
            seen.append(sorted((r.event_uid, r.event_id) for r in got))
    assert all(s == seen[0] for s in seen) and len({u for u, _ in seen[0]}) == 3001


def test_ids_do_not_change_with_files_and_splits(spark, tmp_path, small_splits):
    (tmp_path / "m.json").write_text("\n".join(json.dumps({"EventID": k % 50}) for k in range(2000)))
    ids = []
    for size, more in ((1_000, None), (1 << 27, None), (7_000, "a.json"), (7_000, "z.json")):
        small_splits(size)
        if more:
            (tmp_path / more).write_text(json.dumps({"EventID": 7}) + "\n" * 3 + json.dumps({"EventID": 8}))
        events = read_json_logs(spark, str(tmp_path), layout="lines")[0].where("event_uid LIKE '%m.json'")
        ids.append(sorted((r.event_uid, r.event_id) for r in events.select("event_uid", "event_id").collect()))
    assert all(i == ids[0] for i in ids) and len({u for u, _ in ids[0]}) == 2000
    assert [e for _, e in ids[0]] == [k % 50 for k in range(2000)]


def test_stray_xml_lines_and_binary_logs_are_set_aside(spark, tmp_path):
    from emberwatch.sources.logs import read_logs

    (tmp_path / "e.xml").write_text("<Events>\n<e:Event xmlns:e='urn:e'><e:System><e:EventID>7</e:EventID></e:System></e:Event>\nstray\n</Events>\n")
    events, bad = read_event_xml(spark, str(tmp_path / "e.xml"), layout="lines")
    assert [r.event_id for r in events.collect()] == [7] and [r.value for r in bad.collect()] == ["stray"]
    (tmp_path / "b.evtx").write_bytes(b"ElfFile")
    _, bad = read_logs(spark, str(tmp_path), default_year=2024)
    assert "binary, export as XML" in [r.reason for r in bad.collect()]


def test_rows_of_a_file_stay_with_the_task_that_read_them(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    plan = read_lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_a_line_is_matched_once_per_format(spark):
    lines = spark.createDataFrame([("<34>Jan  5 08:30:01 h app[1]: x", "f", 0), ("no format", "f", 1)], "value string, src_file string, line_id bigint")
    matched = match_lines(lines)
    assert matched._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 3
    assert [(r.kind, r.host, r.pid, r.message, r.vendor) for r in matched.orderBy("line_id").collect()] == [
        ("rfc3164", "h", "1", "x", None), (None, None, None, None, None),
    ]
