"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is a pair of polynomial hashes modulo two primes below 2**31. Hashes
of consecutive chunks compose: hash(AB) = hash(A) * base**len(B) + hash(B). So a text of
over ``chunk`` characters is cut into chunk rows that are hashed in parallel by different
tasks and folded back to the same value that one pass would have given.

Equal fingerprints are not trusted: the texts of every group with two rows or more are
compared chunk by chunk. Grouping by (fingerprint, chunk number, chunk) drops equal chunks
before the shuffle, so a group of any size costs one row per chunk and task; a fingerprint
that keeps two different chunks at one place is split by SHA-256 as well.

Only narrow rows (id, length, fingerprint) are shuffled for the grouping itself. Counts
and the row to keep come from map-side aggregates; the join back is a plain equi-join,
whose skewed partitions adaptive execution splits.

* Null text counts as empty; all empty texts are equal. Very long texts: see above.
* Ties: of equal ids one row stays. Null ids lose against any id; if all ids of a group
  are null, one of the rows stays and ``keep_id`` is null.
* Repeated rows are copies like any other. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.texts import ddl_of, in_bitmap, key_bitmap, text_buffer, text_slices
from emberwatch.sources.store import materialize

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_347_440_723, 911_382_323)
CHUNK = 1 << 20
COMPARE = 1 << 16

_tables: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo prime, by doubling."""
    table = _tables.get((base, prime), np.ones(1, np.uint64))
    while len(table) <= n:
        step = np.uint64(pow(base, len(table), prime))
        table = np.concatenate([table, table * step % np.uint64(prime)])
    _tables[base, prime] = table
    return table


def polynomials(raw: np.ndarray, offsets: np.ndarray, primes: tuple[int, int] = PRIMES) -> list[np.ndarray]:
    """Both hashes of every text in a buffer. Sums stay below 2**63 for texts under 2**23 bytes; longer ones are folded."""
    sizes = np.diff(offsets)
    filled = np.flatnonzero(sizes)
    out = []
    limit = 1 << 23
    for base, prime in zip(BASES, primes, strict=True):
        values = np.zeros(len(sizes), np.uint64)
        if len(filled) and sizes.max() <= limit:
            powers = _powers(base, prime, int(sizes.max()))
            exponents = np.repeat(offsets[1:], sizes) - 1 - np.arange(len(raw))
            terms = (raw.astype(np.uint64) + np.uint64(1)) * powers[exponents]
            values[filled] = np.add.reduceat(terms, offsets[:-1][filled]) % np.uint64(prime)
        else:
            for k in filled:
                h = 0
                for at in range(offsets[k], offsets[k + 1], limit):
                    part = raw[at : min(at + limit, offsets[k + 1])]
                    one = (part.astype(np.uint64) + np.uint64(1)) * _powers(base, prime, len(part))[len(part) - 1 :: -1][: len(part)]
                    h = (h * pow(base, len(part), prime) + int(one.sum(dtype=np.uint64)) % prime) % prime
                values[k] = h
        out.append(values.astype(np.int64))
    return out


def _hash_rows(primes: tuple[int, int]):
    """Replaces the column ``text`` by ``h1`` and ``h2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                h1, h2 = polynomials(*text_buffer(part.column("text")), primes)
                rest = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in rest], pa.array(h1), pa.array(h2)], [*rest, "h1", "h2"])

    return run


def _shifts(column: str, base: int, prime: int) -> F.Column:
    """base**column modulo prime by repeated squaring over the bits of a length below 2**31."""
    squares, value = [], base
    for _ in range(31):
        squares.append(value)
        value = value * value % prime
    return F.expr(
        f"aggregate(array({', '.join(f'{s}L' for s in squares)}), struct(1L AS r, {column} AS n), "
        f"(a, s) -> struct(IF(a.n % 2 = 1, a.r * s % {prime}L, a.r) AS r, shiftright(a.n, 1) AS n), a -> a.r)"
    )


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK,
                 primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row per document: ``id``, ``n_bytes``, ``h1``, ``h2``, ``text_sha256``."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.sha2(text, 256).alias("text_sha256"), text.alias("text"),
    )
    kind = ddl_of(docs, id_column)
    ddl = f"id {kind}, n_bytes bigint, text_sha256 string, h1 bigint, h2 bigint"
    whole = rows.where(F.octet_length("text") <= chunk).mapInArrow(_hash_rows(primes), ddl)
    huge = rows.where(F.octet_length("text") > chunk).withColumn("row_key", F.expr("uuid()"))  # one for all chunks of a text
    pieces = huge.select(
        "id", "n_bytes", "text_sha256", "row_key", "text",
        F.explode(F.expr(f"sequence(0L, (char_length(text) - 1) div {chunk})")).alias("chunk_no"),
    ).select(
        "id", "n_bytes", "text_sha256", "row_key", "chunk_no",
        F.expr(f"substring(text, CAST(chunk_no AS INT) * {chunk} + 1, {chunk})").alias("text"),
    ).withColumn("size", F.octet_length("text").cast("bigint"))
    hashed = pieces.repartition("row_key", "chunk_no").mapInArrow(
        _hash_rows(primes), f"id {kind}, n_bytes bigint, text_sha256 string, row_key string, chunk_no bigint, size bigint, h1 bigint, h2 bigint"
    )
    for k in (0, 1):
        hashed = hashed.withColumn(f"s{k + 1}", _shifts("size", BASES[k], primes[k]))
    # The list of one document's chunks is bounded by its length over the chunk size.
    folded = hashed.groupBy("row_key").agg(
        F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"), F.first("text_sha256").alias("text_sha256"),
        F.array_sort(F.collect_list(F.struct("chunk_no", "h1", "s1", "h2", "s2"))).alias("parts"),
    )
    fold = "aggregate(parts, 0L, (h, p) -> (h * p.s{k} + p.h{k}) % {prime}L)"
    return whole.unionByName(folded.select(
        "id", "n_bytes", "text_sha256", *[F.expr(fold.format(k=k + 1, prime=primes[k])).alias(f"h{k + 1}") for k in (0, 1)]
    ))


KEY = ["h1", "h2", "n_bytes"]


def _key_hash(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (h1.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ h2.astype(np.uint64)) >> np.uint64(7)


def colliding(docs: DataFrame, groups: DataFrame, text_column: str, primes: tuple[int, int]) -> DataFrame:
    """Fingerprints whose texts differ in some chunk, found by comparing all texts of groups of two rows or more."""
    twice = groups.where("group_size > 1")
    narrow = twice.mapInArrow(_with_key_hash, "key bigint")
    bits = docs.sparkSession.sparkContext.broadcast(key_bitmap(narrow, "key"))

    def keep_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                h1, h2 = polynomials(*text_buffer(part.column("text")), primes)
                chosen = pa.array(in_bitmap(bits.value, _key_hash(h1, h2)))
                out = pa.RecordBatch.from_arrays(
                    [part.column("text"), part.column("n_bytes"), pa.array(h1), pa.array(h2)], ["text", "n_bytes", "h1", "h2"]
                )
                yield out.filter(chosen)

    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    chunks = rows.mapInArrow(keep_groups, "text string, n_bytes bigint, h1 bigint, h2 bigint").select(
        *KEY, F.explode(F.expr(f"sequence(0L, greatest(char_length(text) - 1, 0) div {COMPARE})")).alias("chunk_no"), "text"
    ).select(*KEY, "chunk_no", F.expr(f"substring(text, CAST(chunk_no AS INT) * {COMPARE} + 1, {COMPARE})").alias("chunk"))
    return chunks.distinct().groupBy(*KEY, "chunk_no").count().where("count > 1").select(*KEY).distinct()


def _with_key_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h1, h2 = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("h1", "h2"))
        yield pa.RecordBatch.from_arrays([pa.array(_key_hash(h1, h2).astype(np.int64))], ["key"])


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK,
                     primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. The largest id of a group stays."""
    prints = fingerprints(docs, id_column, text_column, chunk, primes).withColumn("row_no", F.monotonically_increasing_id())
    rows = materialize(prints, "fingerprints")
    groups = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row_no")).alias("keep"))
    clash = materialize(colliding(docs, groups, text_column, primes), "collisions")
    if clash.take(1):
        split = rows.join(clash.withColumn("clash", F.lit(True)), KEY, "left").withColumn(
            "part", F.when(F.col("clash"), F.col("text_sha256")).otherwise(F.lit(""))
        ).drop("clash")
        key = [*KEY, "part"]
        groups = split.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row_no")).alias("keep"))
        rows = split
    else:
        key = KEY
    return rows.join(groups, key).select(
        F.col("id").alias(id_column), F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row_no") == F.col("keep.row_no")).alias("kept"), "text_sha256",
    )
