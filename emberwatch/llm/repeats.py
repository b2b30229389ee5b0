"""Maximal repeats of 50 bytes and more across documents, from enhanced suffix arrays.

1. Anchors. Of the 31 strings of 20 bytes inside a 50-byte window the one with the least
   hash is the window's anchor: equal windows have the same anchor at the same place. An
   anchor's context, 30 bytes to each side, holds every window it stands for.
2. Anchors meet by hash in packed rows. Equal contexts need no suffix array: all but those
   of the smallest document are repeated whole. Within a task they are dropped first, so a
   passage in very many documents costs a row per task.
3. Where an anchor has different contexts, one context per kind (that of the smallest
   document) goes on. A task builds the suffix array of the contexts of its anchors with
   their common prefix lengths; a stack scan gives the tree of common-prefix intervals, and
   intervals whose occurrences have different bytes to their left are maximal repeats, with
   all their occurrences.
4. Anchors with very many different contexts (the edges of a passage that a large part of
   all documents share) are found by a count over a hash sample of documents; their
   contexts are cut into windows first, equal windows meet in one task and the different
   ones spread, so no task gets the whole anchor.

Document texts are shuffled once: both joins with them read the same exchange.

A byte is removed if a 50-byte string over it also starts in a document with a smaller id.

* Null text counts as empty; texts under 50 bytes lose nothing. Rows with a null id lose
  nothing and take nothing from others. Rows with equal ids take nothing from each other.
* Very long texts are read whole. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.texts import Substrings, pack, text_buffer, text_slices, unpack
from emberwatch.sources.store import materialize

LENGTH = 50
GRAM = 20
SIDE = LENGTH - GRAM
STRIDE = 1 << 21
POSITION = np.uint64((1 << 22) - 1)
FLUSH = 400_000
BUCKET_ANCHORS = 400_000
BUCKET_CONTEXTS = 12_000
H_BITS, H_BYTES, C_BYTES = 24, 5, 6
# Anchors in more than this share of a hash sample of documents (and in 50 of them) are split further.
HOT_SAMPLE = 20_000
HOT_SHARE = 0.005
HOT_LEAST = 50
WINDOW_FLUSH = 300_000


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place in the text, hash of the anchor, hash of its context) of a buffer of texts."""
    strings = Substrings(raw)
    grams = strings.rolling(GRAM)
    last = np.repeat(offsets[1:], np.diff(offsets)) - LENGTH  # last window start of the text around a byte
    found = []
    for a in range(0, max(0, len(raw) - LENGTH + 1), STRIDE):
        b = min(a + STRIDE, len(raw) - LENGTH + 1)
        v = (grams[a : b + SIDE] & ~POSITION) | np.arange(b + SIDE - a, dtype=np.uint64)
        for step in (1, 2, 4, 8, 15):  # least of 2, 4, 8, 16 and 31 neighbours
            v = np.minimum(v[:-step], v[step:])
        v = v[np.arange(a, b) <= last[a:b]]
        if len(v):
            at = (v & POSITION).astype(np.int64)
            found.append(at[np.concatenate([[True], at[1:] != at[:-1]])] + a)
    at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, at, side="right") - 1
    lo, hi = np.maximum(offsets[text], at - SIDE), np.minimum(offsets[text + 1], at + LENGTH)
    return text, at - offsets[text], grams[at], strings.hash(lo, hi)


def _group_starts(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_PACKED = "bucket int, docs binary, tags binary, counts binary, h binary, c binary, pos binary"


def _packed_anchors(buckets: int, hot: np.ndarray):
    """Anchors of whole tasks in packed rows, one per bucket and FLUSH anchors.

    Buckets from ``buckets`` on are for the hot anchors, dealt by their contexts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for part in text_slices(batch):
                text, at, h, c = anchors(*text_buffer(part.column("text")))
                held.append((part.column("id").to_numpy()[text], part.column("tag").to_numpy()[text], at, h, c))
                size += len(at)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, tags, at, h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = ((h & np.uint64((1 << H_BITS) - 1)) % np.uint64(buckets)).astype(np.int64)
        warm = np.isin(h, hot)
        bucket[warm] = buckets + (c[warm] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((at, tags, ids, bucket))
        bucket = bucket[order]
        edges = np.append(_group_starts(bucket), len(bucket))
        rows = []
        for a, b in zip(edges, edges[1:], strict=False):
            o = order[a:b]
            first = _group_starts(ids[o], tags[o])
            rows.append((
                int(bucket[a]), pack(ids[o][first].view(np.uint64), 8), pack(tags[o][first].view(np.uint32), 4), pack(np.diff(np.append(first, b - a)), 3),
                pack(h[o] >> np.uint64(H_BITS), H_BYTES), pack(c[o], C_BYTES), pack(at[o], 5),
            ))
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows[k : k + 64], strict=True), [pa.int32(), *[pa.binary()] * 6], strict=True)],
                ["bucket", "docs", "tags", "counts", "h", "c", "pos"],
            )

    return run


_FOUND = "id bigint, tag int, pos bigint, anchor bigint"


def _meet(buckets: int):
    """Anchors of one bucket: those in a context that a smaller document also has (``anchor`` null), and those to
    look into (``anchor`` -1 for hot ones)."""

    def run(table: pa.Table) -> pa.Table:
        return _met(table, table.column("bucket")[0].as_py() >= buckets)

    return run


def _met(table: pa.Table, hot: bool) -> pa.Table:
    parts = table.to_pylist()
    ids, tags = (
        np.concatenate([np.repeat(unpack(r[n], w), unpack(r["counts"], 3).astype(np.int64)) for r in parts]) for n, w in (("docs", 8), ("tags", 4))
    )
    ids = ids.view(np.int64)
    h, c, pos = (np.concatenate([unpack(r[n], w) for r in parts]) for n, w in (("h", H_BYTES), ("c", C_BYTES), ("pos", 5)))
    order = np.lexsort((ids, c, h))
    ids, h, c, pos = ids[order], h[order], c[order], pos[order].astype(np.int64)
    tags = tags[order].astype(np.uint32).view(np.int32)
    kinds = _group_starts(h, c)
    least = np.repeat(ids[kinds], np.diff(np.append(kinds, len(ids))))
    starts = _group_starts(h)
    sizes = np.diff(np.append(starts, len(ids)))
    several = np.repeat(
        (np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts))
        & (np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts)), sizes
    )
    whole = ids > least
    look = ~whole & (several | hot)
    out = np.flatnonzero(whole | look)
    name = np.full(len(h), -1) if hot else (h + np.uint64(parts[0]["bucket"] << (8 * H_BYTES))).view(np.int64)
    return pa.table({"id": ids[out], "tag": tags[out], "pos": pos[out], "anchor": pa.array(name[out], mask=whole[out])})


def suffix_array(raw: np.ndarray, ends: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``depth`` bytes, and common prefix lengths with the one before.

    A suffix ends at ``ends`` of its start; what follows counts as 0xFF, which UTF-8 never has.
    """
    beyond = np.array([(1 << (64 - 8 * n)) - 1 for n in range(9)], np.uint64)
    padded = np.concatenate([raw, np.full(depth + 8, 255, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    keys = [
        np.ascontiguousarray(words[starts + k]).view(">u8").ravel().astype(np.uint64) | beyond[np.clip(ends - starts - k, 0, 8)]
        for k in range(0, depth, 8)
    ]
    order = np.lexsort(keys[::-1])
    rank = starts[order]
    lcp = np.zeros(len(starts), np.int64)
    open_ = np.arange(1, len(starts))  # pairs still equal
    for key in keys:
        key = key[order]
        differ = key[open_] ^ key[open_ - 1]
        same = differ == 0
        lcp[open_[same]] += 8
        part = differ[~same]
        # Equal leading bytes of a differing word.
        lead = np.zeros(len(part), np.int64)
        alive = np.ones(len(part), bool)
        for byte in range(7):
            alive &= (part >> np.uint64(56 - 8 * byte)) & np.uint64(255) == 0
            lead += alive
        lcp[open_[~same]] += lead
        open_ = open_[same]
    if len(lcp) > 1:
        lcp[1:] = np.minimum(lcp[1:], np.minimum(ends[order][1:] - rank[1:], ends[order][:-1] - rank[:-1]))
    return order, lcp


def common_prefix_intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of every interval of neighbours with a common prefix of ``least`` or more, by one scan with a stack."""
    out = []
    stack = [(0, 0)]
    for i, length in enumerate([*lcp[1:], 0], start=1):
        begin = i - 1
        while stack[-1][0] > length:
            value, begin = stack.pop()
            if value >= least:
                out.append((value, begin, i - 1))
        if stack[-1][0] < length:
            stack.append((length, begin))
    return out


def maximal_repeats(raw: np.ndarray, offsets: np.ndarray, least: int = LENGTH) -> list[tuple[int, np.ndarray]]:
    """(length, starts) of every repeat of ``least`` bytes or more that more than one byte (or a text's begin) precedes."""
    sizes = np.diff(offsets)
    room = np.maximum(sizes - least + 1, 0)
    starts = np.repeat(offsets[:-1] - (np.cumsum(room) - room), room) + np.arange(int(room.sum()))
    if len(starts) < 2:
        return []
    ends = np.repeat(offsets[1:], room)
    order, lcp = suffix_array(raw, ends, starts, int(sizes.max()))
    at = starts[order]
    begin = np.repeat(offsets[:-1], room)[order]
    left = np.where(at == begin, -1 - np.arange(len(at)), raw[np.maximum(at - 1, 0)].astype(np.int64))
    # Runs of neighbours that share ``least`` bytes; a run with one byte to its left has no maximal repeat in it.
    inside = lcp >= least
    run = np.cumsum(~inside) - 1
    first = np.flatnonzero(~inside)
    diverse = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)
    chosen = np.flatnonzero(diverse[run])
    out = []
    heights = np.where(inside[chosen], lcp[chosen], 0).tolist()
    at, left = at[chosen], left[chosen]
    # Changes of the left byte, counted, tell whether an interval holds more than one.
    turns = np.cumsum(np.concatenate([[0], left[1:] != left[:-1]]))
    for length, a, b in common_prefix_intervals(heights, least):
        if turns[b] != turns[a]:
            out.append((length, at[a : b + 1]))
    return out


_REPEATS = "repeat_id bigint, length bigint, id bigint, tag int, start bigint, repeated boolean"


def _context_repeats(only_repeated: bool):
    """Maximal repeats of the contexts of one bucket; ``repeated`` marks occurrences that a smaller document also has."""

    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_null(table.column("context")))
        table = table.filter(pc.is_valid(table.column("context")))
        raw, offsets = text_buffer(table.column("context").combine_chunks())
        ids = table.column("id").to_numpy()
        base = table.column("base").to_numpy()
        groups = maximal_repeats(raw, offsets) if len(ids) > 1 else []
        lengths = np.array([n for n, _ in groups], np.int64)
        sizes = np.array([len(s) for _, s in groups], np.int64)
        starts = np.concatenate([s for _, s in groups]) if groups else np.zeros(0, np.int64)
        context = np.searchsorted(offsets, starts, side="right") - 1
        doc = ids[context]
        least = np.repeat(np.minimum.reduceat(doc, np.cumsum(sizes) - sizes), sizes) if groups else doc
        repeated = doc > least
        keep = repeated if only_repeated else np.ones(len(doc), bool)
        place = base[context] + starts - offsets[context]
        number = np.repeat(np.arange(len(groups)), sizes)
        if len(ids):
            number += table.column("bucket")[0].as_py() << 32
        found = pa.table({
            "repeat_id": number[keep], "length": np.repeat(lengths, sizes)[keep], "id": doc[keep],
            "tag": table.column("tag").to_numpy()[context][keep], "start": place[keep],
            "repeated": repeated[keep],
        })
        n = len(known)
        sure = pa.table({
            "repeat_id": pa.nulls(n, pa.int64()), "length": pa.array(np.full(n, LENGTH)), "id": known.column("id"),
            "tag": known.column("tag"), "start": known.column("base"), "repeated": pa.array(np.ones(n, bool)),
        })
        return pa.concat_tables([found, sure])

    return run


_CONTEXT = "anchor bigint, id bigint, tag int, base bigint, context binary"


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, found: list of (pos, anchor)) to contexts; those of hot anchors to windows.

    Of equal windows in a task only that of the smallest document goes on; the others are
    known to be repeated (``context`` null).
    """
    windows: list[tuple] = []
    held = 0
    for batch in batches:
        for part in text_slices(batch):
            raw, offsets = text_buffer(part.column("text"))
            ids, tags = part.column("id").to_numpy(), part.column("tag").to_numpy()
            found = part.column("found")
            per_text = np.diff(found.offsets.to_numpy())
            flat = found.flatten()
            pos, name = (flat.field(n).to_numpy() for n in ("pos", "anchor"))
            text = np.repeat(np.arange(part.num_rows), per_text)
            lo = np.maximum(offsets[text], offsets[text] + pos - SIDE)
            hi = np.minimum(offsets[text + 1], offsets[text] + pos + LENGTH)
            data = raw.tobytes()
            cold = name != -1
            yield _contexts(
                name[cold], ids[text[cold]], tags[text[cold]], (lo - offsets[text])[cold],
                [data[a:b] for a, b in zip(lo[cold].tolist(), hi[cold].tolist(), strict=True)],
            )
            if cold.all():
                continue
            lo, hi, text = lo[~cold], hi[~cold], text[~cold]
            room = hi - lo - LENGTH + 1
            start = np.unique(np.repeat(lo - (np.cumsum(room) - room), room) + np.arange(int(room.sum())))
            owner = np.searchsorted(offsets, start, side="right") - 1
            key = Substrings(raw).hash(start, start + LENGTH).view(np.int64)
            windows.append((key, ids[owner], tags[owner], start - offsets[owner], [data[a : a + LENGTH] for a in start.tolist()]))
            held += len(key)
            if held >= WINDOW_FLUSH:
                yield from _least_windows(windows)
                windows, held = [], 0
    if held:
        yield from _least_windows(windows)


def _contexts(anchor: np.ndarray, ids: np.ndarray, tags: np.ndarray, base: np.ndarray, context: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*[pa.array(x) for x in (anchor, ids, tags, base)], pa.array(context, pa.binary())], ["anchor", "id", "tag", "base", "context"]
    )


def _least_windows(windows: list[tuple]) -> Iterator[pa.RecordBatch]:
    key, ids, tags, base = (np.concatenate([w[n] for w in windows]) for n in range(4))
    data = [x for w in windows for x in w[4]]
    order = np.lexsort((ids, key))
    least = np.empty(len(order), np.int64)
    first = _group_starts(key[order])
    least[order] = np.repeat(ids[order][first], np.diff(np.append(first, len(order))))
    for a in range(0, len(key), 50_000):
        part = slice(a, a + 50_000)
        same = ids[part] == least[part]
        yield _contexts(
            np.where(same, key[part], ids[part]), ids[part], tags[part], base[part],
            [x if s else None for x, s in zip(data[part], same.tolist(), strict=True)],
        )


def _remove(id_name: str):
    """Rows (id, text, spans: list of (start, stop)) to what is left of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                raw, offsets = text_buffer(part.column("text"))
                spans = part.column("spans")
                per_text = np.diff(spans.offsets.to_numpy())
                flat = spans.flatten()
                text = np.repeat(np.arange(part.num_rows), per_text)
                a = np.clip(flat.field("start").to_numpy(), 0, None) + offsets[text]
                b = np.minimum(flat.field("stop").to_numpy() + offsets[text], offsets[text + 1])
                change = np.bincount(a, minlength=len(raw) + 1) - np.bincount(b, minlength=len(raw) + 1)
                gone = np.cumsum(change)[:-1] > 0
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                edges = offsets[:-1][offsets[:-1] < offsets[1:]]
                first[edges] = gone[edges]
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
                removed = total(gone)
                left = np.zeros(part.num_rows + 1, np.int32)
                left[1:] = np.cumsum(np.diff(offsets) - removed)
                kept = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(left), pa.py_buffer(raw[~gone].tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(total(first)), kept],
                    [id_name, "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def hot_anchors(rows: DataFrame, count: int) -> np.ndarray:
    """Anchors in a large share of the documents of a hash sample: a few thousand numbers at most.

    Which anchors are hot decides where they meet, not what is found.
    """
    share = min(1.0, HOT_SAMPLE / max(1, count))
    sample = rows.where(F.expr(f"pmod(xxhash64(id, 'sample'), 1000000) < {int(share * 1_000_000) + 1}"))
    least = max(HOT_LEAST, HOT_SHARE * min(count, HOT_SAMPLE))
    found = sample.mapInArrow(_distinct_anchors, "anchor bigint").groupBy("anchor").count().where(F.col("count") >= least)
    return np.array([r.anchor for r in found.collect()], np.int64).view(np.uint64)


def _distinct_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            text, _, h, _ = anchors(*text_buffer(part.column("text")))
            order = np.lexsort((h, text))
            yield pa.RecordBatch.from_arrays([pa.array(h[order][_group_starts(text[order], h[order])].view(np.int64))], ["anchor"])


def found_anchors(rows: DataFrame) -> DataFrame:
    """(id, tag, pos, anchor): repeated contexts (``anchor`` null) and contexts to compare, for rows (id, tag, text)."""
    count, total = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    buckets = max(1, int((total or 0) // (BUCKET_ANCHORS * 16)) + 1)
    packed = rows.mapInArrow(_packed_anchors(buckets, hot_anchors(rows, count)), _PACKED)
    return packed.groupBy("bucket").applyInArrow(_meet(buckets), _FOUND)


def compared_contexts(texts: DataFrame, look: DataFrame, only_repeated: bool) -> DataFrame:
    """Maximal repeats of the contexts of ``look`` (id, tag, pos, anchor); ``texts`` is (id, tag, text)."""
    work = look.agg(F.sum(F.when(F.col("anchor") == -1, SIDE + 1).otherwise(1))).first()[0] or 0
    buckets = work // BUCKET_CONTEXTS + 1
    by_text = look.groupBy("id", "tag").agg(F.collect_list(F.struct("pos", "anchor")).alias("found"))
    contexts = texts.join(by_text, ["id", "tag"]).select("id", "tag", "text", "found").mapInArrow(_cut_contexts, _CONTEXT)
    dealt = contexts.withColumn("bucket", F.expr(f"pmod(xxhash64(anchor), {buckets})"))
    return dealt.groupBy("bucket").applyInArrow(_context_repeats(only_repeated), _REPEATS)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that stay."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    # The tag tells texts with the same id apart.
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.hash(text).alias("tag"), text.alias("text"))
    named = rows.where("id IS NOT NULL")
    found = materialize(found_anchors(named), "anchors")
    texts = named.repartition("id", "tag")  # both joins below read this one exchange
    compared = compared_contexts(texts, found.where("anchor IS NOT NULL"), True)
    spans = found.where("anchor IS NULL").select("id", "tag", (F.col("pos") - SIDE).alias("start"), (F.col("pos") + LENGTH).alias("stop")).unionByName(
        compared.select("id", "tag", "start", (F.col("start") + F.col("length")).alias("stop"))
    )
    by_text = spans.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    nothing = F.expr("CAST(array() AS array<struct<start: bigint, stop: bigint>>)")
    joined = texts.join(by_text, ["id", "tag"], "left").select("id", "text", F.coalesce("spans", nothing).alias("spans"))
    every = joined.unionByName(rows.where("id IS NULL").select("id", "text", nothing.alias("spans")))
    return every.mapInArrow(_remove(id_column), f"`{id_column}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
