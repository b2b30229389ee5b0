"""Jaccard self-join of texts on 5-word shingles by T-occurrence search (DivideSkip).

Two sets of sizes m and n are linked if they share at least T(m, n) = ceil(3 (m + n) / 7)
shingles (similarity 0.75). Then the rarest n - ceil(3n/4) + 1 shingles of each, its short
lists, have one in common; the others are its long lists, which are only probed.

1. One pass gives each text's set size and fingerprint, and a table of 2**21 counters of
   shingles (8 MB, whatever the input) from which "rare" is judged. The order of shingles
   steers the cost only; any fixed order gives the same links. Equal sets are one class.
2. The short lists meet in packed rows; lists of one class are dropped. A list that the
   counters show to be very long is dealt over many tasks.
3. First every class is paired with one class of each of its lists only, so a group of near
   copies costs its size, not its square. Links make components; lists with several
   components left go round again with more classes as leaders (``LEADERS``) while links are
   found. Leaders come from outside a list's largest component if they can. No list of pairs
   is made for what is left then: lists are cut by size class, lists of equal members are
   taken once, and their classes are seated in cells, whose search finds links between
   different components. Pairs inside one need no test.
4. Links are found in cells. The shingle sets of all classes on the lists are written once;
   a cell gets those of a leader and up to 400 others, or of two parts of about 400 classes
   of a list, so a list of n unlinked classes takes n * n / 400 seats. A leader's cell has their short lists only at first: a pair goes on if it
   shares as many as the long ones cannot make up for. A cell's inverted lists are searched
   by DivideSkip: the shorter ones are merged by a heap that skips ids which cannot reach
   T, the longest are probed by bisection.

Classes are told apart by 128-bit fingerprints, nodes of the graph by 64 bits of them.

* Null text or no word: empty set, linked with nothing; ``component_id`` is its own id.
* Repeated rows and equal texts share a component. Null ids: a component's id is the least
  id that is not null, null if there is none. Ties cannot matter: components are unique.
* Very long texts are read whole. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from emberwatch.llm.components import components
from emberwatch.llm.shingles import fingerprints, shingle_sets
from emberwatch.llm.slots import spread_join
from emberwatch.llm.texts import ddl_of, in_bitmap, key_bitmap, mix, pack, text_buffer, text_slices, unpack
from emberwatch.sources.store import materialize, scratch_path

COUNTER_BITS = 21
PARTS = 64
FLUSH = 400_000
BUCKET_POSTINGS = 1_000_000
HOT_LIST = 100_000
CELL = 400
LEADERS = (1, 4)  # classes of each list that the others are paired with, round by round
SET_BYTES = 6  # the high bytes of a shingle's hash by which sets are compared in cells
MU = 0.01  # weight of a probe against a merge step when lists are divided


def least_overlap(m, n):
    """Shingles that sets of these sizes must share for a similarity of 0.75."""
    return -(-3 * (m + n) // 7)


# -- pass 1: sizes, fingerprints, counters -----------------------------------------------


def _describe(id_type: pa.DataType):
    """Rows (id, text_key, text) to sizes and fingerprints, and one counter table per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        seen = False
        for batch in batches:
            for part in text_slices(batch):
                hashes, bounds = shingle_sets(*text_buffer(part.column("text")))
                counts += np.bincount(_slot(hashes), minlength=len(counts))
                f1, f2 = fingerprints(hashes, bounds)
                n = part.num_rows
                seen = True
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_key"), pa.array(np.diff(bounds)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], _DESCRIBED
                )
        if seen:
            rows = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in np.split(counts, PARTS)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(PARTS, id_type), *[pa.nulls(PARTS, pa.int64())] * 4, pa.array(range(PARTS), pa.int32()), pa.array(rows, pa.binary())],
                _DESCRIBED,
            )

    return run


_DESCRIBED = ["id", "text_key", "n_shingles", "f1", "f2", "part", "counts"]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _add_counts(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << COUNTER_BITS) // PARTS, np.int64)
    for data in table.column("counts"):
        total += np.frombuffer(zlib.decompress(data.as_py()), "<i8")
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def counters(parts: DataFrame) -> np.ndarray:
    """Sums of the counter tables of all tasks, in two steps; 64 rows reach the driver."""
    ddl = "part int, counts binary"
    some = parts.withColumn("salt", F.expr("pmod(xxhash64(counts), 64)")).groupBy("part", "salt").applyInArrow(_add_counts, ddl)
    out = np.zeros((PARTS, (1 << COUNTER_BITS) // PARTS), np.int64)
    for r in some.groupBy("part").applyInArrow(_add_counts, ddl).collect():
        out[r.part] = np.frombuffer(zlib.decompress(r.counts), "<i8")
    return out.ravel()


# -- pass 2: short lists -----------------------------------------------------------------

_PACKED = "bucket int, hot boolean, sets binary, sizes binary, counts binary, shingles binary, places binary"


def _rare_first(hashes: np.ndarray, owner: np.ndarray, n_sets: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the shingles of each set from rare to common, their owners and places in that order."""
    order = np.lexsort((hashes, counts[_slot(hashes)], owner))
    owner = owner[order]
    return order, owner, np.arange(len(owner)) - np.searchsorted(owner, np.arange(n_sets))[owner]


def _is_short(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places among the rarest size - ceil(3 size / 4) + 1 shingles."""
    return place <= size + (-3 * size // 4)


def _short_lists(shared, buckets: int, hot_from: int):
    """The rarest shingles of each distinct set of a task, in packed rows per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for part in text_slices(batch):
                hashes, bounds = shingle_sets(*text_buffer(part.column("text")))
                f1, _ = fingerprints(hashes, bounds)
                sizes = np.diff(bounds)
                _, first = np.unique(f1, return_index=True)
                once = np.zeros(len(f1), bool)
                once[first] = True
                owner = np.repeat(np.arange(len(sizes)), sizes)
                keep = once[owner]
                hashes, owner = hashes[keep], owner[keep]
                order, owner, place = _rare_first(hashes, owner, len(sizes), counts)
                short = _is_short(place, sizes[owner])
                hashes, owner, place = hashes[order][short], owner[short], place[short]
                held.append((f1[owner], sizes[owner], hashes, place, counts[_slot(hashes)] >= hot_from))
                size += int(short.sum())
                if size >= FLUSH:
                    yield from _pack_lists(held, buckets)
                    held, size = [], 0
        if size:
            yield from _pack_lists(held, buckets)

    return run


def _pack_lists(held: list[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    sets, sizes, shingles, places, hot = (np.concatenate(x) for x in zip(*held, strict=True))
    bucket = (shingles % np.uint64(buckets)).astype(np.int64)
    bucket[hot] = ((shingles[hot] ^ sets[hot]) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((places, sets, hot, bucket))
    sets, sizes, shingles, places, hot, bucket = (x[order] for x in (sets, sizes, shingles, places, hot, bucket))
    edges = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (hot[1:] != hot[:-1]), [True]]))
    rows = []
    for a, b in zip(edges, edges[1:], strict=False):
        own = sets[a:b]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        rows.append((
            int(bucket[a]), bool(hot[a]), pack(own[first], 8), pack(sizes[a:b][first], 4), pack(np.diff(np.append(first, b - a)), 3),
            pack(shingles[a:b], 8), pack(places[a:b], 4),
        ))
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]
    for k in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows[k : k + 64], strict=True), kinds, strict=True)],
            ["bucket", "hot", "sets", "sizes", "counts", "shingles", "places"],
        )


_LISTS = "shingle bigint, node bigint, size bigint, place bigint"


def _merge_lists(table: pa.Table) -> pa.Table:
    """Lists of a bucket that hold two classes or more, once per class; parts of hot lists as they are."""
    parts = table.to_pylist()
    counts = [unpack(r["counts"], 3).astype(np.int64) for r in parts]
    node = np.concatenate([np.repeat(unpack(r["sets"], 8), c) for r, c in zip(parts, counts, strict=True)])
    size = np.concatenate([np.repeat(unpack(r["sizes"], 4), c) for r, c in zip(parts, counts, strict=True)])
    shingle = np.concatenate([unpack(r["shingles"], 8) for r in parts])
    place = np.concatenate([unpack(r["places"], 4) for r in parts])
    order = np.lexsort((node, shingle))
    node, size, shingle, place = node[order], size[order], shingle[order], place[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (shingle[1:] != shingle[:-1])
    node, size, shingle, place = node[new], size[new], shingle[new], place[new]
    if not parts[0]["hot"]:
        for _ in range(2):  # what stays can lose its only partner
            if len(node):
                live = _live(shingle, size.astype(np.int64), place.astype(np.int64))
                node, size, shingle, place = node[live], size[live], shingle[live], place[live]
    return pa.table({n: pa.array(x.view(np.int64)) for n, x in (("shingle", shingle), ("node", node), ("size", size), ("place", place))})


def _live(shingle: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows for which the bounds of :func:`_may_link` do not rule out every other row of their list.

    ``reach`` is the largest size of a set that can still be linked through a row.
    """
    reach = 7 * (size - place) // 3 - size
    number = np.cumsum(np.concatenate([[0], shingle[1:] != shingle[:-1]]))
    ends = np.append(np.flatnonzero(np.diff(number)) + 1, len(number))
    starts = np.concatenate([[0], ends[:-1]])

    def best_other(values: np.ndarray) -> np.ndarray:
        """The largest value of the other rows of each row's list."""
        order = np.lexsort((values, number))
        top = order[ends - 1]
        second = np.where(ends - starts > 1, values[order[np.maximum(ends - 2, 0)]], -(1 << 60))
        out = values[top][number]
        out[top] = second
        return out

    return (best_other(reach) >= size) & (-best_other(-size) <= reach)


# -- tests of pairs ----------------------------------------------------------------------


def divide_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Ids that stand on ``least`` or more of the sorted lists, with the number of lists they stand on."""
    lists = sorted((x for x in lists if x), key=len, reverse=True)
    if len(lists) < least or least < 1:
        return {}
    n_long = min(least - 1, int(least / (MU * log2(len(lists[0]) + 1) + 1)))
    long, short = lists[:n_long], lists[n_long:]
    need = least - n_long
    out: dict[int, int] = {}
    at = [0] * len(short)
    heap = [(x[0], k) for k, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= need:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            count = len(popped)
            for left, x in enumerate(long, start=1):
                k = bisect_left(x, top)
                count += k < len(x) and x[k] == top
                if count + n_long - left < least:
                    break
            if count >= least:
                out[top] = count
            goal = top + 1
        else:
            # No id below the list head that is ``need``-th in line can be on enough lists.
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            goal = heap[0][0]
        for k in popped:
            at[k] = bisect_left(short[k], goal, at[k])
            if at[k] < len(short[k]):
                heapq.heappush(heap, (short[k][at[k]], k))
    return out


SHORT, WHOLE = ["short"], ["short", "long"]


class Cell:
    """Sets of a cell, the hub's first, with their inverted lists."""

    def __init__(self, table: pa.Table, columns: list[str]):
        self.hub = table.column("hub")[0].as_py()
        sets, self.root, sizes = {}, {}, {}
        for node, r, n, *data in zip(*(table.column(c).to_pylist() for c in ("node", "root", "size", *columns)), strict=True):
            if node not in sets:
                sets[node], self.root[node], sizes[node] = np.concatenate([unpack(x, SET_BYTES) for x in data]), r, n
        self.star = self.hub in sets
        self.nodes = sorted(sets, key=lambda x: (x != self.hub, x))
        self.sets = [sets[x] for x in self.nodes]
        self.sizes = np.array([sizes[x] for x in self.nodes])
        hashes = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
        order = np.argsort(hashes, kind="stable")  # owners ascend inside every list
        hashes, self.owner = hashes[order], owner[order]
        self.starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        self.stops = np.append(self.starts[1:], len(hashes))
        self.keys = hashes[self.starts]
        self.lists: dict[int, list[int]] = {}

    def lists_of(self, q: int) -> list[list[int]]:
        """Lists of a set's shingles that others are on, too."""
        at = np.searchsorted(self.keys, self.sets[q])
        out = []
        for k in at[self.stops[at] - self.starts[at] > 1].tolist():
            if k not in self.lists:
                self.lists[k] = self.owner[self.starts[k] : self.stops[k]].tolist()
            out.append(self.lists[k])
        return out

    def fitting(self, q: int) -> np.ndarray:
        n = self.sizes[q]
        fits = 4 * np.minimum(self.sizes, n) >= 3 * np.maximum(self.sizes, n)
        fits[q] = False
        return fits


def _pairs_table(pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _short_survivors(table: pa.Table) -> pa.Table:
    """Pairs of the hub with sets that share enough of its short lists: at least what their long lists cannot make up for."""
    cell = Cell(table, SHORT)
    if not cell.star:
        return _pairs_table([])
    n, fits = cell.sizes[0], cell.fitting(0)
    need = least_overlap(n, cell.sizes) - -(-3 * np.maximum(n, cell.sizes) // 4) + 1
    if not fits.any():
        return _pairs_table([])
    found = divide_skip(cell.lists_of(0), int(max(1, need[fits].min())))
    return _pairs_table([(cell.hub, cell.nodes[k]) for k, shared in found.items() if fits[k] and shared >= need[k]])


def _cell_links(table: pa.Table) -> pa.Table:
    """What a cell's links join: (least node, other node) of every component that grew.

    First the hub's set is searched for, if it is there, then all sets that are not in the
    cell's largest component. Nodes of one ``root`` count as joined before.
    """
    cell = Cell(table, WHOLE)
    nodes, root = cell.nodes, cell.root
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    largest = root[cell.hub] if cell.star else Counter(root.values()).most_common(1)[0][0]
    touched: set[int] = set()
    for q, node in enumerate(nodes):
        if find(root[node]) == find(largest) and not (cell.star and q == 0):
            continue
        fits = cell.fitting(q)
        if not fits.any():
            continue
        n = cell.sizes[q]
        for k, shared in divide_skip(cell.lists_of(q), int(least_overlap(n, cell.sizes[fits]).min())).items():
            if fits[k] and 4 * shared >= 3 * (n + cell.sizes[k] - shared):
                one, other = find(root[node]), find(root[nodes[k]])
                if one != other:
                    parent[one] = other
                    touched |= {node, nodes[k]}
    grown: dict[int, list[int]] = {}
    for node in sorted(touched):
        grown.setdefault(find(root[node]), []).append(node)
    return _pairs_table([(least, other) for least, *others in grown.values() for other in others])


def _rep_key(node: np.ndarray, id_hash: np.ndarray) -> np.ndarray:
    return mix(node.view(np.uint64) ^ id_hash.view(np.uint64))


def _rep_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, id_hash = (batch.column(n).to_numpy() for n in ("node", "id_hash"))
        yield pa.RecordBatch.from_arrays([pa.array(_rep_key(node, id_hash).view(np.int64))], ["key"])


_SETS = "node bigint, size bigint, short binary, long binary"


def _sets_of(shared, counts):
    """Sets of the wanted classes, packed, and their short lists, each from the text with the class's least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for part in text_slices(batch):
                hashes, bounds = shingle_sets(*text_buffer(part.column("text")))
                f1, _ = fingerprints(hashes, bounds)
                wanted = [
                    k for k in np.flatnonzero(in_bitmap(shared.value, _rep_key(f1, part.column("id_hash").to_numpy()))).tolist()
                    if int(f1[k].view(np.int64)) not in done
                ]
                rows = []
                for k in wanted:
                    node = int(f1[k].view(np.int64))
                    if node in done:
                        continue
                    done.add(node)
                    own = hashes[bounds[k] : bounds[k + 1]]
                    order, _, place = _rare_first(own, np.zeros(len(own), np.int64), 1, counts.value)
                    short = _is_short(place, np.full(len(own), len(own)))
                    parts = (np.sort(own[order[side]]) >> np.uint64(64 - 8 * SET_BYTES) for side in (short, ~short))
                    rows.append((node, len(own), *(pack(x, SET_BYTES) for x in parts)))
                if rows:
                    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "size", "short", "long"])

    return run


def shingle_sets_of(rows: DataFrame, nodes: DataFrame, sets: DataFrame, counts) -> DataFrame:
    """(node, size, short, long) of the classes ``nodes``, written once; ``rows`` is (id, text_key, text), ``sets`` describes them."""
    least = sets.join(nodes, F.col("f1") == F.col("node"), "left_semi").groupBy(F.col("f1").alias("node")).agg(
        F.min(F.xxhash64("id", "text_key")).alias("id_hash")
    )
    bits = rows.sparkSession.sparkContext.broadcast(key_bitmap(least.mapInArrow(_rep_keys, "key bigint"), "key"))
    keyed = rows.where("text IS NOT NULL").select(F.xxhash64("id", "text_key").alias("id_hash"), "text")
    path = scratch_path(rows.sparkSession, "shingle-sets")
    keyed.mapInArrow(_sets_of(bits, counts), _SETS).write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(_SETS).parquet(path)


def _in_cells(seats: DataFrame, sets: DataFrame, columns: list[str], search) -> DataFrame:
    """Pairs (a, b) found in cells; ``seats`` is (hub, cell, node, root). Only sets with a seat are shuffled."""
    seats = materialize(seats, "seats")
    bits = sets.sparkSession.sparkContext.broadcast(key_bitmap(seats, "node"))

    def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits.value, batch.column("node").to_numpy())))

    few = sets.select("node", "size", *columns)
    near = few.mapInArrow(seated, few.schema)
    return near.join(seats, "node").select("hub", "cell", "node", "root", "size", *columns).groupBy("hub", "cell").applyInArrow(
        search, "a bigint, b bigint"
    )


def _star_seats(pairs: DataFrame) -> DataFrame:
    """Cells of pairs (a, b) with the roots of both: a leader ``a`` and about ``CELL`` others at most."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"), F.first("root_a").alias("root"))
    others = pairs.join(hubs.drop("root"), "a").select(
        F.col("a").alias("hub"), F.expr("pmod(xxhash64(b), cells)").alias("cell"), F.col("b").alias("node"), F.col("root_b").alias("root")
    )
    own = hubs.select(F.col("a").alias("hub"), F.explode(F.expr("sequence(0L, cells - 1L)")).alias("cell"), F.col("a").alias("node"), "root")
    return others.unionByName(own)


def star_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join components, among leaders ``a`` and the sets ``b`` paired with them (with ``root_a``, ``root_b``).

    The short lists go first, a quarter of the data; whole sets follow for the pairs left.
    """
    close = _in_cells(_star_seats(pairs), sets, SHORT, _short_survivors)
    close = materialize(close.join(pairs, ["a", "b"]), "close-pairs")
    return _in_cells(_star_seats(close), sets, WHOLE, _cell_links)


def list_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join components, among the classes of each list; ``lists`` is (shingle, node, size, root).

    Sizes within 4:3 fall in the same or in neighbouring classes of powers of 4/3, so each
    class takes part in two sub-lists. Those of one component go, and of sub-lists with
    equal members one stays. Members are dealt into parts of about ``CELL``; every two parts are a cell.
    """
    by_size = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(4 / 3))).cast("int")
    cut = materialize(lists.withColumn("size_class", by_size).selectExpr("shingle", "node", "root", "explode(array(size_class, size_class + 1)) AS size_class"), "sub-lists")
    state = cut.groupBy("shingle", "size_class").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.expr("bit_xor(xxhash64(node))").alias("one"), F.expr("bit_xor(xxhash64(node, 1))").alias("two"),
    ).where("low <> high")
    once = state.groupBy("one", "two", "n").agg(F.min(F.struct("shingle", "size_class")).alias("first")).selectExpr(
        "first.*", f"cast(ceil(n / {CELL}) as int) AS parts"
    )
    # Nodes and shingles are both hashes; the complement keeps a list's name from being taken for a member.
    dealt = spread_join(cut, once, ["shingle", "size_class"], "node").selectExpr(
        "~xxhash64(shingle, size_class) AS hub", "node", "root", "parts", "pmod(xxhash64(node), parts) AS part"
    )
    cells = F.expr("transform(sequence(0L, parts - 1L), o -> least(o, part) * parts + greatest(o, part))")
    return _in_cells(dealt.select("hub", F.explode(cells).alias("cell"), "node", "root"), sets, WHOLE, _cell_links)


def _may_link(x: str, y: str) -> str:
    """Bounds on sizes and on what can still be shared from the place of a common shingle on."""
    return (
        f"4 * least({x}.size, {y}.size) >= 3 * greatest({x}.size, {y}.size) AND "
        f"7 * least({x}.size - {x}.place, {y}.size - {y}.place) >= 3 * ({x}.size + {y}.size)"
    )


def _open_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of lists that still hold several components, with their ``root`` and whether it is the list's largest one."""
    named = materialize(lists.select("shingle", "node", "size", "place").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named-lists")
    members = named.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    state = members.groupBy("shingle").agg(F.count(F.lit(1)).alias("n_roots"), F.max(F.struct("n", "root")).alias("top"))
    state = state.where("n_roots > 1").selectExpr("shingle", "top.root AS largest")
    return spread_join(named, state, ["shingle"], "node").selectExpr("shingle", "node", "size", "place", "root", "root = largest AS inside")


def _linked(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of all classes that are linked to another one."""
    left = lists.selectExpr("*", "node AS root", "true AS inside")
    tried = links = roots = None
    for turn, leaders in enumerate(LEADERS):
        order = f"row_number() OVER (PARTITION BY shingle ORDER BY inside, xxhash64(node, {turn})) AS rank"
        first = left.selectExpr("*", order).where(f"rank <= {leaders}").select("shingle", F.struct("node", "size", "place", "root").alias("y"))
        first = materialize(first, "leaders")
        led = spread_join(left, first.groupBy("shingle").agg(F.collect_list("y").alias("ys")), ["shingle"], "node")
        led = led.select(F.struct("node", "size", "place", "root").alias("x"), F.explode("ys").alias("y"))
        pairs = led.where("x.root <> y.root").where(_may_link("x", "y")).select(
            F.col("y.node").alias("a"), F.col("x.node").alias("b"), F.col("y.root").alias("root_a"), F.col("x.root").alias("root_b")
        ).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "star-pairs")
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried = both if tried is None else tried.unionByName(both)
        found = materialize(star_links(pairs, sets), "star-links")
        links = found if links is None else links.unionByName(found)
        some = bool(found.take(1))
        if some or roots is None:
            roots = materialize(components(links), "roots")
        # Leaders have met their whole list and leave it, so lists of two are done after one round.
        met = first.select("shingle", F.col("y.node").alias("node"))
        left = materialize(_open_lists(left.join(met, ["shingle", "node"], "left_anti"), roots), "open-lists")
        if not left.take(1):
            return roots
        if not some:
            break
    more = materialize(list_links(left, sets), "other-links")
    if not more.take(1):
        return roots
    return materialize(components(links.unionByName(more)), "all-roots")


def similar_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``text_key``, the xxhash64 of its text."""
    named = _rooted(docs, id_column, text_column)
    full = named.where("n_shingles > 0")
    ids = full.groupBy("root", "side").agg(F.min("id").alias("component_id"))
    out = spread_join(full, ids, ["root", "side"], "id").select("id", "n_shingles", "component_id", "text_key")
    none = named.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), "text_key")
    return out.unionByName(none).withColumnRenamed("id", id_column)


def first_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The first document of each component in order of id (nulls last), then ``text_key``: id, ``text_key`` and
    ``copies``, the rows equal in both. Each document without words is one of its own and has ``copies`` 1."""
    named = _rooted(docs, id_column, text_column)
    full = named.where("n_shingles > 0").groupBy("root", "side", "id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "copies")
    first = full.groupBy("root", "side").agg(F.min(place).alias("first")).select("first.id", "first.text_key", "first.copies")
    none = named.where("n_shingles = 0").select("id", "text_key", F.lit(1).cast("bigint").alias("copies")).distinct()
    return first.unionByName(none).withColumnRenamed("id", id_column)


def _rooted(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per document: id, ``text_key``, ``n_shingles`` and its component as (``root``, ``side``)."""
    text = F.col(text_column)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    kind = ddl_of(docs, id_column)
    described = materialize(
        rows.mapInArrow(
            _describe(to_arrow_type(rows.schema["id"].dataType)),
            f"id {kind}, text_key bigint, n_shingles bigint, f1 bigint, f2 bigint, part int, counts binary",
        ), "sets",
    )
    sets = described.where("part IS NULL").select("id", "text_key", "n_shingles", "f1", "f2")
    counts = counters(described.where("part IS NOT NULL").select("part", "counts"))
    texts = rows.where("text IS NOT NULL").select("text")
    buckets = int(counts.sum() // 4 // BUCKET_POSTINGS) + 1
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    hot_from = int(counts.mean()) + HOT_LIST
    packed = texts.mapInArrow(_short_lists(shared, buckets, hot_from), _PACKED)
    lists = materialize(packed.groupBy("bucket", "hot").applyInArrow(_merge_lists, _LISTS), "short-lists")
    roots = _linked(lists, shingle_sets_of(rows, lists.select("node").distinct(), sets, shared))
    named = sets.join(roots.withColumnRenamed("node", "f1"), "f1", "left").select(
        "id", "text_key", "n_shingles", F.coalesce("root", "f1").alias("root"),
        F.when(F.col("root").isNull(), F.col("f2")).otherwise(F.lit(0)).alias("side"),
    )
    return materialize(named, "rooted")
