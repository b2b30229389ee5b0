"""Helpers for operators that read texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` text bytes each; a longer text is a slice of its own."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and its n + 1 offsets, without a copy per row."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ddl_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


# Substring hashes ---------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240115).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_powers["up"]) <= n:
        size = 1 << (n + 1).bit_length()
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Substrings:
    """64-bit hashes of any substring of a byte buffer: equal bytes, equal hash, wherever they stand."""

    def __init__(self, raw: np.ndarray):
        self.up, self.down = _power_tables(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * self.up[: len(raw)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.sums[stops] - self.sums[starts]) * self.down[starts] + (stops - starts).astype(np.uint64))

    def rolling(self, size: int) -> np.ndarray:
        """Hash of every window of ``size`` bytes."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True bytes; a run ends with its text."""
    if len(member) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = member.copy()
    first[1:] &= ~member[:-1]
    edges = offsets[:-1][(offsets[:-1] < offsets[1:])]
    first[edges] = member[edges]
    last = member.copy()
    last[:-1] &= ~member[1:]
    last[edges[1:] - 1] = member[edges[1:] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def byte_table(pattern_bytes: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(pattern_bytes, np.uint8)] = True
    return table


NOT_SPACE = ~byte_table(b" \t\n\x0b\x0c\r")
LETTER_LIKE = byte_table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


# Packed columns -------------------------------------------------------------------------


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, byte by byte, so that leading zeros compress away."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


# Fixed-size filters -------------------------------------------------------------------

BITMAP_BITS = 25


def key_bitmap(df: DataFrame, key: str) -> np.ndarray:
    """Bitmap of 2**25 bits (4 MB) over the low bits of the 64-bit column ``key``.

    The size is fixed, whatever the rows: at most 1,024 rows of 4 KB reach the driver. It
    passes every key of ``df`` and some others, so it only saves work before a join.
    """
    slot = F.expr(f"`{key}` & {(1 << BITMAP_BITS) - 1}")
    parts = df.select((slot / 32768).cast("int").alias("b"), (slot % 32768).alias("p")).groupBy("b")
    bits = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for row in parts.agg(F.bitmap_construct_agg("p").alias("bits")).collect():
        bits[row.b * 4096 : (row.b + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return bits


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = (keys.astype(np.uint64) & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
