"""Near-duplicate detection with SetSketch registers.

A set's sketch has ``REGISTERS`` registers. Register j is the truncated logarithm to the
base ``BASE`` of the least of one exponential number per shingle: ``1 - floor(log_b x)``
within two bytes. Registers of a union are the maxima of the parts' registers, so sketches
of parts of a text merge, and two sets agree in a register about as often as their
Jaccard similarity says.

1. One pass gives each text's set size, fingerprint and sketch. Equal sets are one class.
2. Registers are banded by fours, 32 bands in all: sets of similarity 0.85 share none with
   a chance of (1 - 0.85**4)**32 = 6e-11. Bands that surely hold one class only are told by
   slot counts and never shuffled.
3. Every class of a bucket is paired with the bucket's leader, the least class of its smallest
   component, which has then met the whole bucket and leaves it (``LEADERS``, one a round).
4. A pair's similarity is estimated jointly from the registers above, below and equal and
   both set sizes by maximum likelihood; a pair goes on unless the likelihood ratio
   against 0.85 is beyond exp(20). What is left is confirmed on the full sets.
5. Buckets that still hold several components are cut by size. Their members outside the
   largest component are dealt into parts that meet each other and every part of the largest
   one, each two in a cell; there members of different components are compared on their sets.
   No pair is listed: a cell gives the links that join components. A member of the largest
   component has a seat per part outside; only a bucket of n unlinked classes takes
   n * n / ``PART`` seats. So no link is lost to a bucket's size.

Classes are told apart by 128-bit fingerprints, nodes of the graph by 64 bits of them and
shingles by 64 bits: of n distinct sets some two share a node with a chance of n**2 / 2**65,
3e-6 for ten million, two sets of a million shingles a hash with one of 5e-8.

* Null text or no word: empty set, linked with nothing; ``component_id`` is its own id and
  it is kept. Fewer words than a shingle has: the whole sequence is one shingle.
* Repeated rows and equal texts share a component; every row that carries the component's
  least id is kept. Null ids: a component's id is the least one that is not null, or null.
* Ties cannot matter: components are unique. Very long texts are read whole. Empty table:
  no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.components import components
from emberwatch.llm.shingles import fingerprints, shingle_sets
from emberwatch.llm.slots import FLUSH, PACKED, Filter, SlotPlan, spread_join
from emberwatch.llm.texts import ddl_of, mix, text_buffer, text_slices
from emberwatch.sources.store import materialize

WORDS = 3
PERCENT = 85  # least similarity
ROWS, BANDS = 4, 32
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
RATIO = 20.0  # log-likelihood ratio from which a pair is ruled out
CELL_SHINGLES = 400_000  # a leader's cell
PART = 300  # members of a part
LEADERS = (1,)  # leaders of a bucket, one in each round

_FACTORS = np.random.default_rng(711).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1)
_MASKS = np.random.default_rng(712).integers(1, 1 << 63, REGISTERS, dtype=np.uint64)


# -- sketches ----------------------------------------------------------------------------


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers (sets, REGISTERS) of hashed sets; an empty set has zeros."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, REGISTERS), np.uint16)
    if len(full) == 0:
        return out
    starts = bounds[:-1][full]
    least = np.empty((REGISTERS, len(full)), np.uint64)
    for j in range(REGISTERS):
        np.minimum.reduceat((hashes ^ _MASKS[j]) * _FACTORS[j], starts, out=least[j])
    # The least of uniform numbers becomes the least of exponential ones of rate RATE.
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
    out[full] = np.clip(1 - np.floor(np.log(exponential) / log(BASE)), 0, TOP).T.astype(np.uint16)
    return out


def merge_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sketched sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys: four registers side by side are 64 bits, told apart by band."""
    packed = np.ascontiguousarray(registers).view(np.uint64)
    return mix(packed + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def log_likelihood(j, m, n, above, below, equal):
    """Log-likelihood of similarity ``j`` of sets of sizes m and n whose registers compare like this."""
    u, v = m / (m + n), n / (m + n)

    def chance(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / log(BASE)

    p, q = chance(np.maximum(u - v * j, 0)), chance(np.maximum(v - u * j, 0))
    tiny = 1e-300
    return above * np.log(p + tiny) + below * np.log(q + tiny) + equal * np.log(np.maximum(1 - p - q, 0) + tiny)


def estimate(m, n, above, below, equal) -> np.ndarray:
    """Similarity of greatest likelihood, by golden-section search over what the sizes allow."""
    low, high = np.zeros(len(n)), np.minimum(m / n, n / m)
    golden = (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        left = log_likelihood(a, m, n, above, below, equal) > log_likelihood(b, m, n, above, below, equal)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def may_be_similar(m, n, one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Pairs that their registers and sizes do not rule out."""
    above, below = (one > others).sum(axis=1), (one < others).sum(axis=1)
    equal = REGISTERS - above - below
    m, n = m.astype(np.float64), n.astype(np.float64)
    best = estimate(m, n, above, below, equal)
    goal = np.minimum(PERCENT / 100, np.minimum(m / n, n / m))
    lost = log_likelihood(best, m, n, above, below, equal) - log_likelihood(goal, m, n, above, below, equal)
    return (best >= goal) | (lost <= RATIO)


# -- passes over the texts ---------------------------------------------------------------


def _rep_key(node: np.ndarray, id_hash: np.ndarray) -> np.ndarray:
    return mix(node ^ id_hash)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            hashes, bounds = shingle_sets(*text_buffer(part.column("text")), WORDS)
            f1, f2 = fingerprints(hashes, bounds)
            registers = sketches(hashes, bounds)
            rows = [r.tobytes() if n else None for r, n in zip(registers, np.diff(bounds), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("id_hash"), pa.array(np.diff(bounds)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                 pa.array(rows, pa.binary())], ["id", "id_hash", "n_shingles", "node", "side", "sketch"],
            )


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _band_slots(plan: SlotPlan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(band_keys(_registers(batch.column("sketch"))).ravel())
                size += len(held[-1])
            if size >= FLUSH:
                yield from plan.packed(held)
                held, size = [], 0
        if size:
            yield from plan.packed(held)

    return run


def _shared_bands(plan: SlotPlan, often):
    """(key, node, size) of bands whose slot holds several classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = band_keys(_registers(batch.column("sketch")))
            row, band = np.nonzero(often.value(plan.slots(keys.ravel())).reshape(keys.shape))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[row, band].view(np.int64)), batch.column("node").take(at), batch.column("size").take(at)], ["key", "node", "size"]
            )

    return run


def _sets_of(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                hashes, bounds = shingle_sets(*text_buffer(part.column("text")), WORDS)
                f1, f2 = fingerprints(hashes, bounds)
                keep = np.flatnonzero(wanted.value(_rep_key(f1, part.column("id_hash").to_numpy().view(np.uint64))) & (np.diff(bounds) > 0))
                rows = [hashes[bounds[k] : bounds[k + 1]].tobytes() for k in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f1[keep].view(np.int64)), pa.array(f2[keep].view(np.int64)), part.column("id_hash").take(pa.array(keep)), pa.array(rows, pa.binary())],
                    ["node", "side", "id_hash", "data"],
                )

    return run


# -- pairs in cells ----------------------------------------------------------------------


def _by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            m, n = (batch.column(c).to_numpy() for c in ("m", "n"))
            ok = may_be_similar(m, n, _registers(batch.column("one")), _registers(batch.column("two")))
            yield batch.select(["a", "b", "m", "n"]).filter(pa.array(ok))


def close_pairs(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Pairs (a, b, m, n) with their set sizes that sketches do not rule out; ``sketched`` is (node, size, sketch)."""
    two = pairs.join(sketched.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("two")), "b")
    two = materialize(two, "half-pairs")  # the join below reads it twice
    one = sketched.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("one"))
    both = spread_join(two, one, ["a"], "b").select("a", "b", "m", "n", "one", "two")
    return both.mapInArrow(_by_sketch, "a bigint, b bigint, m bigint, n bigint")


def _seated(seats: DataFrame, sets: DataFrame) -> DataFrame:
    """Seats with the sets of their nodes. Only sets with a seat are shuffled."""
    nodes = materialize(seats.select("node").distinct(), "seated-nodes")
    wanted = sets.sparkSession.sparkContext.broadcast(Filter(nodes, "node", nodes.count()))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value(batch.column("node").to_numpy().view(np.uint64))))

    return sets.mapInArrow(chosen, sets.schema).join(seats, "node")


def _leader_cell(table: pa.Table) -> pa.Table:
    """Links of a leader with the others of its cell."""
    leads = table.column("leads").to_numpy()
    own, others = table.filter(pa.array(leads)).slice(0, 1), table.filter(pa.array(~leads))
    found = np.zeros(0, np.int64)
    if own.num_rows and others.num_rows:
        one = np.frombuffer(own.column("data")[0].as_py(), np.uint64)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in others.column("data")]
        sizes = np.array([len(x) for x in sets])
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        at = np.minimum(np.searchsorted(one, values), len(one) - 1)
        shared = np.bincount(owner[one[at] == values], minlength=len(sets))
        found = others.column("node").to_numpy()[100 * shared >= PERCENT * (len(one) + sizes - shared)]
    return pa.table({"a": pa.array(np.full(len(found), table.column("hub")[0].as_py(), np.int64)), "b": pa.array(found)})


def leader_links(close: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among close pairs. A cell holds a leader ``a`` and others of about ``CELL_SHINGLES`` shingles in all."""
    hubs = close.groupBy("a").agg(F.ceil(F.sum("n") / CELL_SHINGLES).cast("int").alias("cells"))
    seats = spread_join(close, hubs, ["a"], "b").selectExpr("a AS hub", "pmod(xxhash64(b), cells) AS cell", "b AS node", "false AS leads")
    own = hubs.selectExpr("a AS hub", "explode(sequence(0L, cells - 1L)) AS cell", "a AS node", "true AS leads")
    return _seated(materialize(own.unionByName(seats), "seats"), sets).groupBy("hub", "cell").applyInArrow(_leader_cell, "a bigint, b bigint")


def _part_cell(table: pa.Table) -> pa.Table:
    """Links that join components in a cell: members outside the largest one against all others, by inverted lists."""
    nodes, roots = table.column("node").to_numpy(), table.column("root").to_numpy()
    _, first = np.unique(nodes, return_index=True)
    nodes, roots = nodes[first], roots[first]
    data = table.column("data")
    sets = [np.frombuffer(data[int(k)].as_py(), np.uint64) for k in first]
    sizes = np.array([len(x) for x in sets])
    names, group = np.unique(roots, return_inverse=True)
    largest = np.bincount(group).argmax()
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    links = []
    for q in np.flatnonzero(group != largest).tolist():
        low, high = np.searchsorted(values, sets[q]), np.searchsorted(values, sets[q], side="right")
        n = high - low
        shared = np.bincount(owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(sets))
        linked = np.flatnonzero((100 * shared >= PERCENT * (sizes[q] + sizes - shared)) & (group != group[q]))
        for k in linked.tolist():
            if group[k] != group[q]:  # joined by a link of this turn
                links.append((int(nodes[q]), int(nodes[k])))
                group[group == group[k]] = group[q]
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def part_links(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join components, among the members of each open bucket; ``left`` is (key, node, size, root, inside).

    Sizes within 20:17 fall in the same or in neighbouring classes of its powers, so each member
    takes part in two sub-buckets. Those of one component go; of equal ones one stays. Cells are
    (part outside, part inside) and, of the parts outside, every two, numbered -1 and below.
    """
    by_size = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int")
    cut = materialize(left.withColumn("c", by_size).selectExpr("key", "node", "root", "inside", "explode(array(c, c + 1)) AS size_class"), "sub-buckets")
    state = cut.groupBy("key", "size_class").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("n_in"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.expr("bit_xor(xxhash64(node))").alias("one"), F.expr("bit_xor(xxhash64(node, 1))").alias("two"),
    ).where("low <> high")
    least = F.min(F.struct("key", "size_class", "n_in")).alias("first")
    once = state.groupBy("one", "two", "n").agg(least).selectExpr(
        "first.key", "first.size_class", f"ceil((n - first.n_in) / {PART}) AS n_out", f"greatest(ceil(first.n_in / {PART}), 1L) AS n_in"
    )
    part = "pmod(xxhash64(node), IF(inside, n_in, n_out)) AS part"
    dealt = spread_join(cut, once, ["key", "size_class"], "node").selectExpr("key AS hub", "size_class", "node", "root", "inside", "n_out", "n_in", part)
    others = "transform(filter(sequence(0L, n_out - 1L), o -> o <> part), o -> -1L - (least(o, part) * n_out + greatest(o, part)))"
    cells = F.expr(
        f"IF(inside, transform(sequence(0L, n_out - 1L), o -> o * n_in + part), concat(transform(sequence(0L, n_in - 1L), i -> part * n_in + i), {others}))"
    )
    seats = materialize(dealt.select("hub", "size_class", F.explode(cells).alias("cell"), "node", "root"), "part-seats")
    return _seated(seats, sets).groupBy("hub", "size_class", "cell").applyInArrow(_part_cell, "a bigint, b bigint")


# -- rounds ------------------------------------------------------------------------------


def _open_buckets(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows of buckets that hold several components, with ``root``, whether it is the bucket's largest one, and the bucket's leader."""
    if roots is None:  # each class is a component of its own
        named = buckets.withColumn("root", F.col("node"))
        by_root = named.selectExpr("key", "root", "1L AS n", "struct(node, size) AS least")
    else:
        named = materialize(buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named-buckets")
        by_root = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("least"))
    state = by_root.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_roots"), F.max(F.struct("n", "root")).alias("largest"), F.min(F.struct("n", "root", "least")).alias("lead")
    )
    state = state.where("n_roots > 1").selectExpr("key", "largest.root AS largest", "struct(lead.least.*, lead.root) AS lead")
    return spread_join(named, state, ["key"], "node").selectExpr("key", "node", "size", "root", "root = largest AS inside", "lead")


def _links(left: DataFrame, sketched: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(node, root) of all classes that are linked to another one; ``left`` are the open buckets of single classes."""
    roots = links = tried = None
    for _ in LEADERS:
        if not left.take(1):
            return roots
        fits = left.where(f"lead.root <> root AND 100 * least(size, lead.size) >= {PERCENT} * greatest(size, lead.size)")
        pairs = fits.selectExpr("lead.node AS a", "node AS b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti").join(tried.selectExpr("b AS a", "a AS b"), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        close = materialize(close_pairs(pairs, sketched), "close-pairs")
        found = materialize(leader_links(close, sets), "links")
        if found.take(1):
            links = found if links is None else links.unionByName(found)
            roots = materialize(components(links), "roots")
        left = materialize(_open_buckets(left.where("node <> lead.node").select("key", "node", "size"), roots), "open-buckets")
    if not left.take(1):
        return roots
    more = materialize(part_links(left, sets), "part-links")
    if not more.take(1):
        return roots
    return materialize(components(more if links is None else links.unionByName(more)), "roots")


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``kept``."""
    text = F.col(text_column)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(id_column), text).alias("id_hash"), text.alias("text"))
    described = materialize(
        rows.mapInArrow(_describe, f"id {ddl_of(docs, id_column)}, id_hash bigint, n_shingles bigint, node bigint, side bigint, sketch binary"), "sketches"
    )
    full = described.where("n_shingles > 0")
    classes = materialize(
        full.groupBy("node", "side").agg(
            F.min("id").alias("class_id"), F.min("id_hash").alias("id_hash"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch")
        ), "classes",
    )
    n_keys = classes.count() * BANDS
    plan = SlotPlan(n_keys, 2)
    often = materialize(plan.frequent(classes.select("sketch").mapInArrow(_band_slots(plan), PACKED)), "shared-slots")
    share = docs.sparkSession.sparkContext.broadcast
    keep = share(Filter(often, "slot", often.count()))
    found = classes.select("node", "size", "sketch").mapInArrow(_shared_bands(plan, keep), "key bigint, node bigint, size bigint")
    buckets = materialize(found, "buckets")

    # A filter passes some bands of one class too: only now are buckets known exactly.
    first = materialize(_open_buckets(buckets, None), "open-buckets")
    # Sets of all classes that share a band, from the text with each one's least id hash.
    reps = materialize(classes.join(first.select("node").distinct(), "node", "left_semi").select("node", "side", "id_hash", "size"), "wanted-classes")
    wanted = share(Filter(reps.select("node", "id_hash").mapInArrow(_rep_keys, "key bigint"), "key", reps.count()))
    texts = rows.where("text IS NOT NULL").select("id_hash", "text")
    sets = texts.mapInArrow(_sets_of(wanted), "node bigint, side bigint, id_hash bigint, data binary")
    rep = ["node", "side", "id_hash"]  # repeated rows have equal ones: one exchange serves both steps
    once = sets.dropDuplicates(rep).join(reps.select(*rep, "size"), rep)
    sets = materialize(once.select("node", "size", "data"), "sets")
    roots = _links(first, classes.select("node", "size", "sketch"), sets)
    named = classes.select("node", "side", "class_id")
    if roots is None:
        named = named.withColumn("component_id", F.col("class_id"))
    else:
        joined = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = joined.groupBy("root").agg(F.min("class_id").alias("component_id"))
        named = spread_join(materialize(joined, "rooted"), least, ["root"], "node")
    linked = spread_join(full, named.select("node", "side", "component_id"), ["node", "side"], "id_hash").select("id", "n_shingles", "component_id")
    none = described.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = linked.unionByName(none).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("id", id_column)


def _rep_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, id_hash = (batch.column(n).to_numpy().view(np.uint64) for n in ("node", "id_hash"))
        yield pa.RecordBatch.from_arrays([pa.array(_rep_key(node, id_hash).view(np.int64))], ["key"])
