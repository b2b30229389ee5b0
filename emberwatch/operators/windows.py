"""Greedy time windows per key that hold up when one key has most of the rows.

Both window kinds here are order-dependent: the next window starts at the first
qualifying event after the end of the last one. They are not tumbling, sliding or
session windows.

* anchored: every event qualifies; a window is ``[t, t + width]``.
* dense: an event qualifies if ``[t, t + width]`` holds at least ``min_count`` events.

A plain ``Window.partitionBy(key)`` would put a hot key into one task. Here no task and no
row grows with a key:

1. events are counted per (rule, key, instant) with a map-side combine;
2. instants and the ends of their windows are sorted over all tasks and cut into cells of
   about ``CELL_ROWS`` rows, wherever that falls inside a key (:func:`_in_cells`). A cell counts
   what lies in the windows that begin and end in it; for the others it gives both running
   counts, and the counts of the cells between are added. That leaves the qualifying starts;
3. starts and window ends are cut into cells again. Inside a cell each start points to the
   first one behind its window, and chains of pointers are followed by doubling. A key that
   lies inside one cell is done;
4. of the other keys a cell gives (entry, exit) rows: where a chain that comes in from the
   left may begin, and to which start of a later cell it leads. Pointer doubling over these
   rows, log2(cells) equi-joins, marks the entries that are on the chain from the key's
   first start, and the cells walk on from there.

Events are then assigned to windows by an equi-join on (key, width-sized slot). A slot
meets at most two windows, so the join has a fixed fan-out and a hot key spreads over
its slots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.sqltext import lit
from emberwatch.schema import col, epoch_micros
from emberwatch.sources.store import materialize

MICROS = 1_000_000
CELL_ROWS = 200_000  # rows of a cell: bounds what one task holds, however many of them a key has

# Rows of the operators below carry the columns
#   rule int, key string, t bigint (microseconds), width bigint (microseconds), minimum int
# so that windows of many rules, each with its own width, are found in one pass.
BY = ["rule", "key"]
SLOT_LEN = "greatest(width, 1L)"


def _in_cells(written: DataFrame, n_rows: int, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Rows of a written table with the number of their ``cell``, and the number of cells: a cell is a range of the rows sorted by ``order``."""
    n_cells = max(1, -(-n_rows // CELL_ROWS))
    if n_cells == 1:
        return written.coalesce(1).withColumn("cell", F.lit(0)), 1
    ranged = written.repartitionByRange(n_cells, *order).withColumn("cell", F.spark_partition_id())
    return materialize(ranged, f"{name}-cells"), n_cells


def _with_ends(rows: DataFrame) -> DataFrame:
    """Each row as an instant (``x`` is t, side 0) and as the end of its window (``x`` is t + width, side 1)."""
    return rows.selectExpr("*", "inline(array(struct(t AS x, 0 AS side), struct(t + width AS x, 1 AS side)))")


ORDER = [*BY, "x", "side"]


class _Cell:
    """A cell's rows in order, with the number of each row's (rule, key) group."""

    def __init__(self, table: pa.Table):
        key = table.column("key").combine_chunks()
        if isinstance(key, pa.ChunkedArray):
            key = pa.concat_arrays(key.chunks)
        names = key.dictionary_encode()
        self.keys = names.dictionary.to_pylist()
        rule, code = table.column("rule").to_numpy(), names.indices.to_numpy(zero_copy_only=False)
        group = rule.astype(np.int64) * len(self.keys) + code
        x, side = table.column("x").to_numpy(), table.column("side").to_numpy()
        self.order = np.lexsort((side, x, group))
        self.group, self.x, self.side = group[self.order], x[self.order], side[self.order]
        self.t, self.width = (table.column(c).to_numpy()[self.order] for c in ("t", "width"))
        self.rule, self.code = rule[self.order], code[self.order]
        self.first = np.ones(len(x), bool)
        self.first[1:] = self.group[1:] != self.group[:-1]
        self.number = np.cumsum(self.first) - 1  # of the group, from 0

    def column(self, table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy()[self.order]

    def edges(self) -> np.ndarray:
        """Rows of the groups that may go on in other cells: the least and the greatest by rule and key."""
        named = {n: (int(self.rule[k]), self.keys[self.code[k]].encode()) for n, k in enumerate(np.flatnonzero(self.first).tolist())}
        ends = {min(named, key=named.get), max(named, key=named.get)}
        return np.isin(self.number, list(ends))

    def partners(self) -> np.ndarray:
        """Place of the other row of each row's window (instant or end), -1 if it is in another cell."""
        by_t = np.lexsort((self.side, self.t, self.number))
        same = (self.number[by_t][1:] == self.number[by_t][:-1]) & (self.t[by_t][1:] == self.t[by_t][:-1])
        out = np.full(len(self.t), -1)
        a, b = by_t[:-1][same], by_t[1:][same]
        out[a], out[b] = b, a
        return out

    def rows(self, at: np.ndarray) -> dict[str, pa.Array]:
        return {
            "rule": pa.array(self.rule[at].astype(np.int32)),
            "key": pa.DictionaryArray.from_arrays(pa.array(self.code[at], pa.int32()), pa.array(self.keys, pa.string())).cast(pa.string()),
        }


def _table(rows_of: _Cell, at: np.ndarray, **columns) -> pa.Table:
    return pa.table({**rows_of.rows(at), **{n: c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for n, c in columns.items()}})


# kind 0: a start (t). kind 1: running count of a window's begin or end (t, side, n). kind 2: a key's count in a cell (n).
_COUNTED = "rule int, key string, kind int, t bigint, width bigint, side int, cell int, n bigint, minimum int"


def _count_cell(several: bool):
    def run(table: pa.Table) -> pa.Table:
        cell = _Cell(table)
        n, minimum = cell.column(table, "n"), cell.column(table, "minimum")
        number = int(table.column("cell")[0].as_py())
        counted = np.where(cell.side == 0, n, 0)
        running = np.cumsum(counted)
        running -= (running - counted)[np.flatnonzero(cell.first)][cell.number]
        before = np.where(cell.side == 0, running - counted, running)  # events before an instant, up to a window's end
        other = cell.partners()
        starts = np.flatnonzero((cell.side == 0) & (other >= 0))
        starts = starts[before[other[starts]] - before[starts] >= minimum[starts]]
        parts = [(starts, 0, before[starts])]
        if several:
            halves = np.flatnonzero(other < 0)
            firsts = np.flatnonzero(cell.first)
            totals = np.add.reduceat(counted, firsts) if len(firsts) else counted
            torn = np.unique(cell.number[halves])
            parts += [(halves, 1, before[halves]), (firsts[torn], 2, totals[torn])]
        return pa.concat_tables([
            _table(cell, at, kind=np.full(len(at), kind, np.int32), t=cell.t[at], width=cell.width[at], side=cell.side[at].astype(np.int32),
                   cell=np.full(len(at), number, np.int32), n=values.astype(np.int64), minimum=minimum[at].astype(np.int32))
            for at, kind, values in parts
        ])

    return run


def _dense_starts(instants: DataFrame) -> DataFrame:
    """(rule, key, t, width) of the instants whose window holds ``minimum`` events."""
    cells, n_cells = _in_cells(_with_ends(instants), 2 * instants.count(), ORDER, "counted")
    counted = cells.groupBy("cell").applyInArrow(_count_cell(n_cells > 1), _COUNTED)
    if n_cells == 1:
        return counted.select(*BY, "t", "width")
    counted = materialize(counted, "window-counts")
    upto = counted.where("kind = 2").selectExpr(
        *BY, "cell", "coalesce(sum(n) OVER (PARTITION BY rule, key ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto"
    )
    torn = counted.where("kind = 1").join(upto, [*BY, "cell"]).groupBy(*BY, "t", "width", "minimum").agg(
        F.expr("sum(CASE WHEN side = 1 THEN n + upto ELSE -n - upto END) AS inside")
    )
    return counted.where("kind = 0").select(*BY, "t", "width").unionByName(torn.where("inside >= minimum").select(*BY, "t", "width"))


def _chain_ends(follower: np.ndarray) -> np.ndarray:
    """The last place on the chain of pointers from every place; -1 ends a chain."""
    last, step = np.arange(len(follower)), follower.copy()
    while (moving := step >= 0).any():
        at = step[moving]
        last[moving], step[moving] = last[at], step[at]
    return last


def _on_chains(follower: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Places on the chains of pointers from ``heads``."""
    on, step = np.zeros(len(follower), bool), follower.copy()
    on[heads] = True
    while (step >= 0).any():
        at = step[on]
        on[at[at >= 0]] = True
        step = np.where(step >= 0, step[step], -1)
    return on


# kind 0: the start of a window (t). kind 1: a chain that enters at t leaves its cell from ``to``. kind 2: t points to
# ``to`` in this cell, or behind the cell where ``to`` is null. kind 3: a start of a key that may be in several cells.
_LINKED = "rule int, key string, kind int, cell int, t bigint, to bigint, width bigint"


def _link_cell(several: bool):
    def run(table: pa.Table) -> pa.Table:
        cell = _Cell(table)
        number = int(table.column("cell")[0].as_py())
        starts = np.flatnonzero(cell.side == 0)
        # The first start at or behind every row, if it is of the same key.
        after = np.searchsorted(starts, np.arange(len(cell.x)))
        inside = after < len(starts)
        at = starts[np.minimum(after, len(starts) - 1)] if len(starts) else np.zeros(len(after), np.int64)
        follower = np.where(inside & (cell.number[at] == cell.number), after, -1) if len(starts) else np.full(len(after), -1)
        other = cell.partners()
        points = np.where(other[starts] >= 0, follower[other[starts]], -1)
        first = np.ones(len(starts), bool)
        first[1:] = cell.number[starts][1:] != cell.number[starts][:-1]
        open_ = cell.edges() if several else np.zeros(len(cell.x), bool)
        heads = np.flatnonzero(first & ~open_[starts])
        none = pa.nulls(0, pa.int64())
        chosen = starts[_on_chains(points, heads)]
        parts = [(chosen, 0, cell.t[chosen], pa.nulls(len(chosen), pa.int64()))]
        if several and open_.any():
            foreign = np.flatnonzero((cell.side == 1) & (other < 0) & open_)
            met = follower[foreign]
            entries = np.unique(np.concatenate([np.flatnonzero(first & open_[starts]), met[met >= 0]]))
            last = starts[_chain_ends(points)[entries]] if len(entries) else np.zeros(0, np.int64)
            left = np.flatnonzero(open_[starts] & (points < 0) & (other[starts] >= 0))
            target = pa.array(np.where(met >= 0, cell.t[starts[np.maximum(met, 0)]] if len(starts) else 0, 0), mask=met < 0)
            mine = starts[open_[starts]]
            parts += [
                (starts[entries], 1, cell.t[starts[entries]], pa.array(cell.t[last])), (foreign, 2, cell.t[foreign], target),
                (starts[left], 2, cell.t[starts[left]], pa.nulls(len(left), pa.int64())), (mine, 3, cell.t[mine], pa.nulls(len(mine), pa.int64())),
            ]
        return pa.concat_tables([
            _table(cell, rows, kind=np.full(len(rows), kind, np.int32), cell=np.full(len(rows), number, np.int32), t=t,
                   to=to if len(rows) else none, width=cell.width[rows])
            for rows, kind, t, to in parts
        ])

    return run


def _entries_on_chain(linked: DataFrame) -> DataFrame:
    """(rule, key, cell, entry) of the cells' entries that are on the chain from their key's first start."""
    entries = linked.where("kind = 1").select(*BY, "cell", "width", F.col("t").alias("entry"), F.col("to").alias("last"))
    ahead = entries.groupBy(*BY, "cell").agg(F.min("entry").alias("first"))
    pointers = linked.where("kind = 2").select(*BY, "cell", F.col("t").alias("last"), "to")
    # What leads behind a cell leads to the first start of the key in a later cell.
    pointed = pointers.select(*BY, "cell").distinct().join(ahead, [*BY, "cell"], "full").selectExpr(
        *BY, "cell", "min(first) OVER (PARTITION BY rule, key ORDER BY cell ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next"
    )
    known = pointers.join(pointed, [*BY, "cell"]).selectExpr(*BY, "last", "coalesce(to, next) AS to").where("to IS NOT NULL")
    jump = materialize(entries.join(known, [*BY, "last"]).select(*BY, "entry", "to").distinct(), "jumps")
    found = entries.groupBy(*BY).agg(F.min("entry").alias("entry"))
    while jump.take(1):
        steps = found.join(jump, [*BY, "entry"]).select(*BY, F.col("to").alias("entry"))
        found = materialize(found.unionByName(steps).distinct(), "entries")
        further = jump.select(*BY, F.col("entry").alias("to"), F.col("to").alias("end"))
        jump = materialize(jump.join(further, [*BY, "to"]).select(*BY, "entry", F.col("end").alias("to")), "jumps")
    return entries.join(found, [*BY, "entry"]).select(*BY, "cell", "entry").distinct()


def _walk_cell(table: pa.Table) -> pa.Table:
    """Starts of windows of one key's part in a cell, from the entry on."""
    t = np.sort(table.column("t").to_numpy())
    width, entry = table.column("width")[0].as_py(), table.column("entry")[0].as_py()
    follower = np.searchsorted(t, t + width, side="right")
    chosen = t[_on_chains(np.where(follower < len(t), follower, -1), np.searchsorted(t, [entry]))]
    first = table.slice(0, 1)
    return pa.table({c: pc.take(first.column(c), pa.array(np.zeros(len(chosen), np.int64))) for c in (*BY, "width")} | {"anchor": pa.array(chosen)})


def greedy_windows(rows: DataFrame) -> DataFrame:
    """Window starts (rule, key, width, anchor) of keyed rows."""
    instants = materialize(rows.where("key IS NOT NULL").groupBy(*BY, "t", "width", "minimum").agg(F.expr("count(1) AS n")), "instants")
    single = instants.where("minimum <= 1").select(*BY, "t", "width")
    starts = materialize(single.unionByName(_dense_starts(instants.where("minimum > 1"))), "starts")
    cells, n_cells = _in_cells(_with_ends(starts), 2 * starts.count(), ORDER, "starts")
    linked = cells.groupBy("cell").applyInArrow(_link_cell(n_cells > 1), _LINKED)
    if n_cells > 1:
        linked = materialize(linked, "links")
    done = linked.where("kind = 0").select(*BY, "width", F.col("t").alias("anchor"))
    if n_cells == 1:
        return done
    entered = linked.where("kind = 3").select(*BY, "cell", "t", "width").join(_entries_on_chain(linked), [*BY, "cell"])
    walked = entered.groupBy(*BY, "cell").applyInArrow(_walk_cell, "rule int, key string, width bigint, anchor bigint")
    return done.unionByName(walked)


def first_stage_windows(rows: DataFrame, stages: int) -> DataFrame:
    """Per key the earliest start whose window holds ``minimum`` distinct stages.

    ``bits`` of a row has bit i set if the row is of stage i. The next instant of every
    stage is looked for inside a cell; from later cells only their first ones are needed.
    """
    instants = materialize(rows.groupBy(*BY, "t", "width", "minimum").agg(F.expr("bit_or(bits) AS bits")), "stage-instants")
    cells, _ = _in_cells(instants, instants.count(), [*BY, "t"], "stages")
    of = [f"min(CASE WHEN bits & {1 << i} <> 0 THEN t END)" for i in range(stages)]
    later = "OVER (PARTITION BY rule, key ORDER BY cell ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    firsts = cells.groupBy(*BY, "cell").agg(*[F.expr(f"{e} AS f{i}") for i, e in enumerate(of)])
    behind = firsts.selectExpr(*BY, "cell", *[f"min(f{i}) {later} AS f{i}" for i in range(stages)])
    here = "OVER (PARTITION BY rule, key, cell ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    local = cells.selectExpr(*BY, "cell", "t", "width", "minimum", *[f"{e} {here} AS n{i}" for i, e in enumerate(of)])
    hits = " + ".join(f"coalesce(cast(coalesce(n{i}, f{i}) - t <= width AS int), 0)" for i in range(stages))
    return local.join(behind, [*BY, "cell"]).where(f"{hits} >= minimum").groupBy(*BY, "width").agg(F.expr("min(t) AS anchor"))


def _floor_div(value: str, length: str) -> str:
    """Integer floor division in SQL, exact for every bigint."""
    return f"({value} - pmod({value}, {length})) div {length}"


def assign(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Attach to each keyed row the ``anchor`` of the window it lies in; others are dropped."""
    first = _floor_div("anchor", SLOT_LEN)
    # Windows of one key start more than a width apart: at most one starts in a slot.
    slots = anchors.selectExpr(*BY, "anchor", f"explode(array({first}, {first} + 1)) AS slot")
    return (
        rows.selectExpr("*", f"{_floor_div('t', SLOT_LEN)} AS slot")
        .join(slots, [*BY, "slot"])
        .where("t BETWEEN anchor AND anchor + width")
        .drop("slot")
    )


def keyed(events: DataFrame, key: str | Column, width_seconds: int, minimum: int) -> DataFrame:
    """Events with the columns the operators above need, for one rule."""
    return events.withColumns(
        {
            "rule": F.lit(0), "key": col(key), "t": epoch_micros("event_ts"),
            "width": F.lit(int(width_seconds) * MICROS).cast("bigint"), "minimum": F.lit(int(minimum)),
        }
    )


def dense_windows(events: DataFrame, key: str | Column, width_seconds: int, min_count: int) -> DataFrame:
    """Events in windows of at least ``min_count`` events, with ``key``, ``t`` and ``anchor``."""
    rows = keyed(events, key, width_seconds, min_count)
    return assign(rows, greedy_windows(rows))


def anchored_windows(events: DataFrame, key: str | Column, width_seconds: int) -> DataFrame:
    """Every event with the ``anchor`` of its window."""
    return dense_windows(events, key, width_seconds, 1)


def stage_bits(stage: str, stages: list[str]) -> str:
    """SQL for the bit of a stage name."""
    arms = " ".join(f"WHEN {lit(name)} THEN {1 << i}" for i, name in enumerate(stages))
    return f"CASE {stage} {arms} ELSE 0 END"


def first_stage_window(events: DataFrame, key: str | Column, stage: str, stages: list[str],
                       width_seconds: int, min_stages: int) -> DataFrame:
    """Events of the earliest window of each key with ``min_stages`` distinct stages, with ``anchor``."""
    rows = keyed(events, key, width_seconds, min_stages).withColumn("bits", F.expr(stage_bits(stage, stages)))
    return assign(rows, first_stage_windows(rows, len(stages)))


def prefix_window(rows: DataFrame, keys: list[str], ts: str, width_seconds: int) -> DataFrame:
    """Rows within ``width_seconds`` of the first row of their key; adds ``first_ts``.

    The first times are a small aggregate, so the rows are never sorted per key.
    """
    first = rows.groupBy(*keys).agg(F.min(ts).alias("first_ts"))
    return rows.join(first, keys).where(
        F.col(ts) <= F.col("first_ts") + F.make_dt_interval(secs=F.lit(int(width_seconds)))
    )


def count_by_field(events: DataFrame, field: str) -> DataFrame:
    """Counts of the non-empty values of one field."""
    return events.where(F.col(field) != "").groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))
