"""Counting 64-bit keys cheaply: which keys occur often enough to be worth a row of their own.

Tasks count their keys, cut them to slots of as many bytes as the number of keys asks for
and send sorted slots in packed rows. Keys that share a slot are counted together, so what
falls below the minimum is surely rare; the rest still has to be counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.texts import pack, unpack

FLUSH = 4_000_000
RANGE_KEYS = 1_000_000
MAX_BITS = 30
PACKED = "part int, slots binary, counts binary"
COLUMNS = ["part", "slots", "counts"]


class SlotPlan:
    """How keys are cut: bytes of a slot and the number of ranges, both from the expected number of keys."""

    def __init__(self, expected: int, minimum: int):
        self.minimum = minimum
        self.width = min(8, max(4, (max(1, expected).bit_length() + 4 + 7) // 8))
        self.range_bits = min(22, max(0, (expected // RANGE_KEYS).bit_length()))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - 8 * self.width)

    def packed(self, keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Packed rows of a task's keys: distinct slots with counts, which stop at the minimum."""
        slots, counts = np.unique(self.slots(np.concatenate(keys)), return_counts=True)
        part = (slots >> np.uint64(8 * self.width - self.range_bits)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
        rows = [
            (int(part[a]), pack(np.diff(slots[a:b], prepend=np.uint64(0)), self.width), np.minimum(counts[a:b], self.minimum).astype(np.uint8).tobytes())
            for a, b in zip(edges, edges[1:], strict=False)
        ]
        for k in range(0, len(rows), 64):
            columns = zip(*rows[k : k + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], COLUMNS)

    def frequent(self, packed: DataFrame) -> DataFrame:
        """(slot) of all slots that hold the minimum or more."""
        width, minimum = self.width, self.minimum

        def merge(table: pa.Table) -> pa.Table:
            slots = np.concatenate([np.cumsum(unpack(x.as_py(), width)) for x in table.column("slots")])
            counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("counts")])
            slots, at = np.unique(slots, return_inverse=True)
            often = np.bincount(at, counts, len(slots)) >= minimum
            return pa.table({"slot": pa.array(slots[often].astype(np.int64))})

        return packed.groupBy("part").applyInArrow(merge, "slot bigint")


class Filter:
    """Bitmap over 64-bit keys that passes all keys put in and few others.

    It has about 16 bits a key, 2**30 bits (128 MB) at most; beyond that it passes more
    than it need, which costs rows later on but loses none.
    """

    def __init__(self, keys: DataFrame, column: str, expected: int):
        self.bits = min(MAX_BITS, max(16, (expected * 16).bit_length()))
        slot = F.expr(f"`{column}` & {(1 << self.bits) - 1}L")
        parts = keys.select((slot / 32768).cast("int").alias("b"), (slot % 32768).alias("p")).groupBy("b")
        self.map = np.zeros((1 << self.bits) // 8, np.uint8)
        for row in parts.agg(F.bitmap_construct_agg("p").alias("bits")).collect():
            self.map[row.b * 4096 : (row.b + 1) * 4096] = np.frombuffer(row.bits, np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.astype(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.map[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], salt_from: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """Join rows to a table with one row per key so that a key of very many rows is dealt over ``salts`` tasks.

    The table is first brought to the (key, salt) that occur; ``rows`` should be a written table, it is read twice.
    """
    salted = rows.withColumn("_salt", F.expr(f"pmod(xxhash64({salt_from}), {salts})"))
    near = salted.select(*keys, "_salt").distinct().join(table, keys)
    return salted.join(near, [*keys, "_salt"], how).drop("_salt")
