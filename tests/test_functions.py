from __future__ import annotations

import hashlib
import ipaddress
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberwatch.functions import events as ev
from emberwatch.functions import text as tx
from emberwatch.functions import timestamps as ts
from emberwatch.functions.network import is_private_ip
from emberwatch.schema import epoch_micros, severity_rank, ts_iso

IPS = [
    "", "-", "host", "10.1.2.3", "8.8.8.8", "192.0.0.9", "192.0.0.8", "198.51.100.5", "203.0.113.9", "100.64.0.1",
    "224.0.0.1", "255.255.255.255", "01.2.3.4", "1.2.3", "1.2.3.400", "172.31.0.1", "172.32.0.1", "185.220.101.34",
    "::1", "::", "fe80::1%eth0", "2001:4860:4860::8888", "2001:db8::1", "fc00::1", "ff02::1", "::ffff:8.8.8.8",
    "::ffff:10.0.0.1", "64:ff9b::1", "2002::1", "2001:20::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
    "1:2:3:4:5:6:7:8:9", "12345::", "2a00:1450:4001::1", "fec0::1", "2001:0:1::", "2001:1::1", "2001:1::3", "::g",
]


def values(spark, items, expr, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_private_ip_follows_the_standard_library(spark):
    def known(ip):
        if ip in ("", "-"):
            return True
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return False
        return a.is_private or a.is_loopback or a.is_reserved

    assert values(spark, IPS, is_private_ip("x")) == [known(ip) for ip in IPS]


def test_entropy(spark):
    def known(s):
        return -sum(p * math.log2(p) for c in set(s) if (p := s.count(c) / len(s)))

    words = ["", "aaaa", "abcd", "a1b2c3d4e5f6g7h8i9j0", "ééa"]
    got = values(spark, words, tx.label_entropy("x"))
    assert got == pytest.approx([known(s) if s else 0.0 for s in words])
    assert math.copysign(1, got[1]) == 1  # no negative zero


@pytest.mark.parametrize(
    "text,want",
    [
        ("2024-01-15T08:30:01.5Z", datetime(2024, 1, 15, 8, 30, 1, 500000)),
        ("2024-01-15T08:30:01Z", datetime(2024, 1, 15, 8, 30, 1)),
        ("2024-01-15T08:30:01.123456", datetime(2024, 1, 15, 8, 30, 1, 123456)),
        ("2024-01-15 08:30:01", datetime(2024, 1, 15, 8, 30, 1)),
        ("01/15/2024 12:05:06 AM", datetime(2024, 1, 15, 0, 5, 6)),
        ("01/15/2024 01:05:06 pm", datetime(2024, 1, 15, 13, 5, 6)),
        ("2024-03-10T02:30:00Z", datetime(2024, 3, 10, 2, 30)),  # does not exist in New York
        ("2024-02-30T00:00:00Z", None),
        ("2024-01-15", None),
        ("yesterday", None),
        ("", None),
    ],
)
def test_event_time(spark, text, want):
    assert values(spark, [text], ts.event_time("x")) == [want]


def test_other_clocks(spark):
    assert values(spark, ["Jan  5 08:30:01", "Foo 5 08:30:01", "2024-01-05T08:30:01.25+02:00"], ts.syslog_time("x", 2023)) == [
        datetime(2023, 1, 5, 8, 30, 1), None, datetime(2024, 1, 5, 8, 30, 1, 250000),
    ]
    assert values(spark, ["1705307401500", "Jan 15 2024 08:30:01", "Jan 15 08:30:01", "2024-01-15 08:30:01", "x"], ts.cef_time("x", 2023)) == [
        datetime(2024, 1, 15, 8, 30, 1, 500000), datetime(2024, 1, 15, 8, 30, 1), datetime(2023, 1, 15, 8, 30, 1),
        datetime(2024, 1, 15, 8, 30, 1), None,
    ]
    assert values(spark, ["2024-01-15T08:30:01.123+0530", "2024-01-15T08:30:01Z", "n/a"], ts.siem_time("x")) == [
        datetime(2024, 1, 15, 8, 30, 1, 123000), datetime(2024, 1, 15, 8, 30, 1), None,
    ]


def test_epoch_micros_ignores_the_session_zone(spark):
    got = values(spark, [datetime(2024, 3, 10, 2, 30, 0, 7), datetime(1969, 12, 31, 23, 59, 59)], epoch_micros("x"), "timestamp_ntz")
    assert got == [1710037800000007, -1000000]
    iso = values(spark, [datetime(2024, 3, 10, 2, 30, 0, 7), datetime(2024, 3, 10, 2, 30)], ts_iso("x"), "timestamp_ntz")
    assert iso == ["2024-03-10T02:30:00.000007", "2024-03-10T02:30:00"]


def test_message_functions(spark):
    lines = [
        "Failed password for invalid user admin from 10.0.1.50 port 22 ssh2",
        "Accepted publickey for root from 1.2.3.4 port 1",
        "session closed for user bob",
        "sudo: bob : COMMAND=/bin/ls",
        "tcp listen",
        "nothing here",
    ]
    assert values(spark, lines, tx.message_event_id("x", F.lit(7))) == [4625, 4624, 4634, 4688, 7, 7]
    assert values(spark, lines, tx.message_user("x")) == ["admin", "root", "bob", "", "", ""]
    assert values(spark, lines, tx.message_ip("x")) == ["10.0.1.50", "1.2.3.4", "", "", "", ""]
    assert values(spark, lines, tx.message_category("x")) == ["authentication"] * 4 + ["network", "unknown"]


def test_small_lookups(spark):
    assert values(spark, [4625, 13, 9], ev.event_category("x"), "int") == ["authentication", "registry", "unknown"]
    assert values(spark, [15, 12, 7, 4, 3], ev.level_severity("x"), "int") == ["critical", "high", "medium", "low", "info"]
    assert values(spark, ["low", "critical", "info"], ev.severity_level("x")) == [3, 15, 5]
    assert values(spark, ["info", "critical", "odd"], severity_rank("x")) == [0, 4, -1]
    assert values(spark, ["3", "10", "x"], ev.cef_category("x")) == ["authentication", "privilege", "unknown"]
    assert values(spark, ["C:\\A\\Net.EXE", "tar", ""], tx.tool_name("x")) == ["net", "tar", ""]
    assert values(spark, ["1.5", " 2 ", "x", ""], tx.number_or_zero("x")) == [1.5, 2.0, 0.0, 0.0]
    assert values(spark, ["T1059.001 - A T1003", "none"], tx.technique_ids("x", F.lit("T1110"))) == [
        ["T1059.001", "T1003", "T1110"], ["T1110"],
    ]
    assert values(spark, [r"a\=b", r"x\\y", r"l\nm"], ev.cef_unescape("x")) == ["a=b", "x\\y", "l\nm"]
    shape = ev.shape_category(F.lit(0), F.lit(""), F.lit(""), F.col("x"), F.lit(""))
    assert values(spark, ["1.1.1.1", ""], shape) == ["network", "unknown"]
    channel = ev.channel_category(F.col("x"), F.lit(0), F.lit("none"))
    assert values(spark, ["Windows PowerShell", "System"], channel) == ["process", "unknown"]


def test_record_lookup(spark):
    docs = [
        '{"EventID":1,"EventData":{"User":"a","QueryName":"q.x"},"rule":{"groups":["","g1"],"mitre":{"id":{"k":"T1"}}},"n":""}',
        '{"User":null,"username":"b","Name":"top.x"}',
    ]
    raw = "try_parse_json(x)"
    assert values(spark, docs, ev.first_field(raw, "SubjectUserName", "User", "username")) == ["a", "b"]
    assert values(spark, docs, ev.dns_query(raw)) == ["q.x", "top.x"]
    assert values(spark, docs, ev.first_path(raw, "n", "rule.groups", default="d")) == ["g1", "d"]
    assert values(spark, docs, ev.first_path(raw, "rule.mitre.id")) == ["T1", ""]


def test_fingerprint_covers_fields_but_not_raw(events):
    rows = events.frame([(0, 1, {"raw_json": '{"a":1}'}), (0, 1, {"raw_json": '{"a":2}'}), (1, 1, {})])
    got = [r[0] for r in rows.orderBy("event_uid").select(ev.event_fingerprint()).collect()]
    assert got[0] == got[1] != got[2]
    text = rows.orderBy("event_uid").select(ev.event_json()).first()[0]
    assert hashlib.sha256(text.encode()).hexdigest() == got[0]
