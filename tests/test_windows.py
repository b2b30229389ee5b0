"""Window operators against a direct restatement of their definitions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import windows as w

BASE = datetime(2024, 3, 1)


def brute_dense(times, width, minimum):
    times = sorted(times)
    out, i = [], 0
    while i < len(times):
        j = i
        while j < len(times) and times[j] - times[i] <= width:
            j += 1
        if j - i >= minimum:
            out.append((times[i], j - i))
            i = j
        else:
            i += 1
    return out


def brute_stage(rows, width, minimum):
    rows = sorted(rows)
    for t, _ in rows:
        inside = [(u, s) for u, s in rows if t <= u <= t + width]
        if len({s for _, s in inside}) >= minimum:
            return t, len(inside)
    return None


def make(spark, data):
    rows = [
        (key, BASE + timedelta(seconds=t), f"{i:07d}", stage)
        for i, (key, t, stage) in enumerate((k, t, s) for k, items in data.items() for t, s in items)
    ]
    return spark.createDataFrame(rows, "key string, event_ts timestamp_ntz, event_uid string, stage string")


@pytest.fixture(scope="module")
def random_data():
    rng = random.Random(7)
    data = {}
    for k in range(60):
        spread = rng.choice([20, 100, 1000, 5000])
        n = rng.randint(1, 120)
        data[f"k{k}"] = [(rng.randint(0, spread), rng.choice("abcd")) for _ in range(n)]
    # One hot key with no gap anywhere: its whole time line is one chain over many blocks.
    data["hot"] = [(t, rng.choice("abcd")) for t in range(0, 6000) for _ in range(rng.choice([1, 1, 2]))]
    return data


@pytest.mark.parametrize("width,minimum,cell", [(10, 1, 500), (37, 6, 200_000), (300, 5, 150), (37, 5, 900)])
def test_dense_windows_match_brute_force(spark, random_data, monkeypatch, width, minimum, cell):
    monkeypatch.setattr(w, "CELL_ROWS", cell)
    got = (
        w.dense_windows(make(spark, random_data), "key", width, minimum)
        .groupBy("key", "anchor").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    base = (BASE - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    got = sorted((r["key"], (r["anchor"] - base) / 1e6, r["n"]) for r in got)
    want = sorted((k, t, n) for k, items in random_data.items() for t, n in brute_dense([t for t, _ in items], width, minimum))
    assert got == want


@pytest.mark.parametrize("width,minimum,cell", [(3, 2, 200_000), (10, 3, 700), (60, 4, 300)])
def test_first_stage_window_matches_brute_force(spark, random_data, monkeypatch, width, minimum, cell):
    monkeypatch.setattr(w, "CELL_ROWS", cell)
    got = (
        w.first_stage_window(make(spark, random_data), "key", "stage", list("abcd"), width, minimum)
        .groupBy("key", "anchor").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    base = (BASE - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    got = {r["key"]: ((r["anchor"] - base) / 1e6, r["n"]) for r in got}
    want = {k: b for k, items in random_data.items() if (b := brute_stage(items, width, minimum))}
    assert got == want


def test_dense_key_has_no_long_row_or_task(spark, monkeypatch):
    """One key with 200 events a second: windows reach over several cells, and nothing is collected per key."""
    monkeypatch.setattr(w, "CELL_ROWS", 10_000)
    seen = {}
    real = w.materialize

    def watched(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "collect_set" not in plan
        out = real(df, name)
        if "cell" in out.columns and name.endswith("cells"):
            seen[name] = out.groupBy("cell").count().agg(F.max("count")).first()[0]
        return out

    monkeypatch.setattr(w, "materialize", watched)
    rows = spark.range(60_000).selectExpr("0 AS rule", "'k' AS key", "id * 5000 AS t", "60000000L AS width", "5000 AS minimum")
    got = [r.anchor for r in w.greedy_windows(rows).orderBy("anchor").collect()]
    assert got == [k * 60_005_000 for k in range(5)]
    assert set(seen) == {"counted-cells", "starts-cells"} and max(seen.values()) <= 2 * 10_000


def test_anchored_windows_restart_after_the_window(spark):
    data = {"a": [(0, "x"), (10, "x"), (600, "x")]}
    got = w.anchored_windows(make(spark, data), "key", 300).groupBy("anchor").count().orderBy("anchor").collect()
    assert [r["count"] for r in got] == [2, 1]


def test_window_end_is_inclusive_and_microseconds_count(spark):
    rows = [("a", BASE, "1", "x"), ("a", BASE + timedelta(seconds=5), "2", "x"),
            ("b", BASE, "3", "x"), ("b", BASE + timedelta(seconds=5, microseconds=1), "4", "x")]
    df = spark.createDataFrame(rows, "key string, event_ts timestamp_ntz, event_uid string, stage string")
    got = w.dense_windows(df, "key", 5, 2).groupBy("key").count().collect()
    assert [(r["key"], r["count"]) for r in got] == [("a", 2)]


def test_prefix_window_keeps_only_the_first_hour(spark):
    data = {"a": [(0, "x"), (3600, "x"), (3601, "x"), (3700, "x")]}
    assert w.prefix_window(make(spark, data), ["key"], "event_ts", 3600).count() == 2


def test_count_by_field_skips_empty(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), ("b",)], "v string")
    assert sorted((r.value, r.n) for r in w.count_by_field(df, "v").collect()) == [("a", 2), ("b", 1)]
