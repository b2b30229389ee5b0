"""Streams give what the batch job gives."""

from __future__ import annotations

import json
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from conftest import START

from emberwatch.operators import bursts
from emberwatch.operators.settings import DetectorSettings
from emberwatch.operators.stateless import stateless_rules
from emberwatch.plans.scan import ScanConfig
from emberwatch.sources import store
from emberwatch.streaming import live
from emberwatch.streaming.detectors import LIVE_DETECTORS, live_detector
from emberwatch.workload import scan_queries


def run(spark, stream, folder):
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def land(frames, path):
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)


def test_bursts_over_batch_borders(spark, events, tmp_path):
    """A burst cut in half by two micro-batches is still one burst."""
    rows = [(i * 5, 4625, {"source_ip": "9.9.9.9", "username": f"u{i % 2}"}) for i in range(8)]
    rows += [(400 + i * 5, 4625, {"source_ip": "8.8.8.8", "username": "x"}) for i in range(3)]
    end = [(90000, 4625, {"source_ip": "end", "username": "x"})]
    path = str(tmp_path / "in")
    land([events.frame(rows[:4]), events.frame(rows[4:]), events.frame(end)], path)
    got = run(spark, live_detector(live.stream_event_table(spark, path, 1), "brute_force", delay="1 minute"), tmp_path)
    want = bursts.detect(events.frame(rows), "brute_force")
    columns = ["rule_name", "severity", "description", "alert_ts", "evidence_count", "evidence", "recommendation"]
    assert got.select(columns).collect() == want.select(columns).collect()
    assert got.count() == 1


def test_only_windowed_detectors_stream(spark, events, tmp_path):
    path = str(tmp_path / "in")
    land([events.frame([(0, 1, {})])], path)
    with pytest.raises(ValueError):
        live_detector(live.stream_event_table(spark, path), "privilege_escalation")
    assert set(LIVE_DETECTORS) < set(bursts.KEYED_DETECTORS)


def test_attack_chain_over_batch_borders(spark, events, tmp_path):
    """Stages of a chain that come in different micro-batches; only the first window of a user counts, late events do not."""
    fields = {"username": "u", "target_username": "u"}
    stages = [(0, 4625, fields), (600, 4672, fields), (900, 4624, {**fields, "logon_type": 3})]
    later = [(90000, 4625, fields), (90060, 4672, fields)]
    other = [(30, 4625, {"username": "v", "target_username": "v"})]
    path = str(tmp_path / "in")
    batches = [stages[:1] + other, stages[1:2], stages[2:] + later, [(10, 4672, {"username": "v", "target_username": "v"})], [(900000, 4625, {**fields, "username": "w"})]]
    land([events.frame(b).withColumn("event_uid", F.concat(F.lit(f"{k}-"), "event_uid")) for k, b in enumerate(batches)], path)
    folders = sorted(Path(path).glob("*.parquet"), key=lambda f: f.stat().st_mtime)
    assert len(folders) == len(batches)
    got = run(spark, live_detector(live.stream_event_table(spark, path, 1), "attack_chain", delay="1 minute"), tmp_path).collect()
    want = bursts.detect(events.frame(stages), "attack_chain").collect()
    assert [(r.description, r.alert_ts, r.evidence_count, len(r.evidence)) for r in got] == [
        (r.description, r.alert_ts, r.evidence_count, len(r.evidence)) for r in want
    ]


def test_state_is_one_entry_per_slot():
    """The processor reads a slot and those its windows reach, never all slots of a key."""
    import numpy as np

    from emberwatch.streaming.stateful import SLOTS, dense_start, slot_length, stage_start

    ts = np.array([0, 5, 9, 20, 21, 22, 40])
    assert dense_start(ts, np.arange(7), 3, 3) == 3 and dense_start(ts, np.arange(3), 3, 3) is None
    assert stage_start(ts, np.array([1, 1, 2, 1, 2, 4, 1]), np.arange(7), 10, 3) == 3
    assert slot_length(80) * SLOTS == 80 and slot_length(3) == 1


class _State(dict):
    """A state variable that counts how often it is written and read."""

    writes = reads = 0

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        self.reads += 1
        return self[key]

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    removeKey = dict.pop

    def exists(self):
        return () in self

    def get(self):
        return self[()]

    def update(self, value):
        self[()] = value


def test_state_is_written_and_read_by_slot_not_by_event():
    from types import SimpleNamespace

    import pandas as pd

    from emberwatch.streaming.stateful import WindowProcessor

    states, timers = {}, set()
    handle = SimpleNamespace(
        getMapState=lambda name, *_: states.setdefault(name, _State()), getValueState=lambda name, *_: states.setdefault(name, _State()), registerTimer=timers.add,
    )
    processor = WindowProcessor(80_000_000, 3, 5, 10, False)
    processor.init(handle)
    ts = [1_000_000 + 100_000 * k for k in range(1200)]
    frame = pd.DataFrame({"t": ts, "event_uid": [f"{k:05}" for k in range(1200)], "value": "v", "bits": 1, "item": [f"i{k}" for k in range(1200)]})
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    processor.handleInputRows(("k",), iter([frame[k::40] for k in range(40)]), clock)
    n_slots = len({t // 10_000_000 for t in ts})
    assert sum(s.writes for s in states.values()) <= 2 * n_slots
    out = [row for at in sorted(timers) for found in processor.handleExpiredTimer(("k",), clock, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)) for row in found.itertuples()]
    assert [(r.anchor, r.n, r.items) for r in out] == [(ts[0], 801, [f"i{k}" for k in range(10)]), (ts[801], 399, [f"i{k}" for k in range(801, 811)])]
    assert states["slots"].reads <= 2 * n_slots and not states["slots"] and not states["items"]


def test_lines_to_alerts_once(spark, tmp_path):
    line = {"TimeCreated": START.isoformat() + "Z", "EventID": 1102, "Computer": "H"}
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(line) + "\n{broken\n" + json.dumps({**line, "EventID": 5}) + "\n")
    (folder / "b.json").write_text(json.dumps(line) + "\n")
    found = live.live_alerts(live.stream_log_events(live.stream_lines(spark, str(folder), 1), "json"), stateless_rules(DetectorSettings(), ["defense_evasion"]))
    assert run(spark, found, tmp_path / "all").count() == 2
    assert run(spark, live.new_alerts(found), tmp_path / "new").count() == 1


def test_syslog_stream(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("<34>Jan 15 08:30:01 h1 sshd[1]: Failed password for bob from 1.2.3.4 port 2\nnoise\n")
    got = run(spark, live.stream_log_events(live.stream_lines(spark, str(folder)), "syslog", 2024), tmp_path / "o").collect()
    assert [(r.event_id, r.username, r.event_ts) for r in got] == [(4625, "bob", START + timedelta(seconds=1))]


def test_events_are_deduplicated(spark, events, tmp_path):
    path = str(tmp_path / "in")
    frame = events.frame([(0, 1, {}), (1, 1, {})])
    land([frame, frame], path)
    assert run(spark, live.new_events(live.stream_event_table(spark, path, 1)), tmp_path).count() == 2


def test_batch_scan_sees_each_batch_alone(spark, events, tmp_path):
    path, seen = str(tmp_path / "in"), []
    rows = [(i, 4625, {"source_ip": "9.9.9.9"}) for i in range(8)]
    land([events.frame(rows[:4] + [(0, 1102, {})]), events.frame(rows[4:])], path)
    query = live.start_batch_scan(
        live.stream_event_table(spark, path, 1), lambda df, i: seen.extend(r.rule_name for r in df.collect()),
        ScanConfig(exclude=("chain",)), str(tmp_path / "cp"), availableNow=True,
    )
    query.awaitTermination()
    assert seen == ["Log Clearing Detected"]


def test_batches_leave_no_scratch_tables(spark, events, tmp_path):
    scratch = Path(store.shared_folder(spark)) / spark.sparkContext.applicationId
    before = set(scratch.glob("*"))
    path, seen = str(tmp_path / "in"), []
    land([events.frame([(i, 4625, {"source_ip": "9.9.9.9"}) for i in range(8)])], path)
    query = live.start_batch_scan(
        live.stream_event_table(spark, path, 1), lambda df, i: seen.extend(r.rule_name for r in df.collect()), ScanConfig(),
        str(tmp_path / "cp"), availableNow=True,
    )
    query.awaitTermination()
    assert len(seen) == 1 and set(scratch.glob("*")) == before


def test_late_events_are_set_aside(spark, events, tmp_path):
    path = str(tmp_path / "in")
    land([events.frame([(7200, 1, {})]), events.frame([(0, 1, {}), (3599, 1, {}), (3600, 1, {}), (9000, 1, {})]), events.frame([(5399, 1, {}), (5400, 1, {})])], path)
    late = str(tmp_path / "late")
    live.start_late_router(live.stream_event_table(spark, path, 1), late, 3600, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    got = sorted((r.event_ts - START).total_seconds() for r in live.late_events(spark, late).collect())
    assert got == [0, 3599, 5399]


def test_late_files_keep_the_partitions_of_their_table(spark, events, tmp_path):
    scan_queries._late_files(events.frame([(i, 4625, {}) for i in range(60)]).repartition(3), str(tmp_path / "in"))
    assert [len(list((tmp_path / "in" / folder).glob("part-*"))) for folder in ("first", "behind")] == [3, 3]
