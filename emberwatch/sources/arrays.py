"""Elements of JSON array files of any size.

A file is read as pieces between closing braces, split over tasks wherever it is long. What a
byte means depends on all bytes before it: whether it stands inside a string, and how deep.

1. Each byte range (split) is reduced to how it changes that state: whether it turns the
   string state over, and its change of depth if it begins outside or inside a string.
2. These changes are chained along each file's ranges (a file has one per 128 MB).
3. Each range is cut, from its own state on, at the commas and brackets of the outermost
   array. Elements inside a range are done; the ends at its borders are put together by the
   number of the element, which is a running count of cuts along the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHANGES = "src_file string, block bigint, turns int, outside int, inside int"
_PIECES = "src_file string, block bigint, k bigint, text string, cuts bigint"
_OPEN, _CLOSE = np.zeros(256, np.int8), np.zeros(256, np.int8)
_OPEN[[ord("["), ord("{")]] = 1
_CLOSE[[ord("]"), ord("}")]] = 1


def pieces_of(spark, path: str, **options: str) -> DataFrame:
    """(value, src_file, block) between closing braces, in the order of the file inside a block."""
    return spark.read.options(**options).option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("block"),
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, dict]]:
    """Bytes of consecutive rows of one (file, block), with the braces the reader took away."""
    for batch in batches:
        files, blocks = batch.column("src_file").to_pylist(), batch.column("block").to_pylist()
        values = batch.column("value").to_pylist()
        start = 0
        for k in range(1, len(files) + 1):
            if k == len(files) or files[k] != files[start] or blocks[k] != blocks[start]:
                row = {n: batch.column(n)[start].as_py() for n in batch.schema.names if n != "value"}
                yield (files[start], blocks[start]), ("}".join(values[start:k]) + "}").encode(), row
                start = k


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, and which of them are quotes that no backslash escapes. Pieces end in a brace, so no escape reaches over."""
    raw = np.frombuffer(data, np.uint8)
    place = np.arange(len(raw))
    plain = np.where(raw != 92, place, -1)
    before = np.concatenate([[-1], np.maximum.accumulate(plain)[:-1]])
    return raw, (raw == 34) & ((place - before - 1) % 2 == 0)


def _change_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple, list[int]] = {}
    for key, data, _ in _blocks(batches):
        raw, quotes = _marks(data)
        now = total.setdefault(key, [0, 0, 0])
        string = (np.cumsum(quotes) - quotes + now[0]) % 2 == 1
        step = _OPEN[raw].astype(np.int64) - _CLOSE[raw]
        now[1] += int(step[~string].sum())
        now[2] += int(step[string].sum())
        now[0] = (now[0] + int(quotes.sum())) % 2
    rows = [(*k, *v) for k, v in total.items()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)],
        [c.split()[0] for c in _CHANGES.split(", ")],
    )


def block_states(pieces: DataFrame) -> DataFrame:
    """(src_file, block, string, depth) at the begin of each byte range, and whether the file is ``complete``: all strings and brackets end."""
    changes = pieces.select("value", "src_file", "block").mapInArrow(_change_pass, _CHANGES)
    lines = changes.groupBy("src_file").agg(F.array_sort(F.collect_list(F.struct("block", "turns", "outside", "inside"))).alias("line"))
    folded = """aggregate(line, named_struct('s', 0, 'd', 0, 'seen', cast(array() as array<struct<block:bigint,string:int,depth:int>>)),
        (a, b) -> named_struct('s', (a.s + b.turns) % 2, 'd', a.d + IF(a.s = 0, b.outside, b.inside),
                               'seen', array_append(a.seen, named_struct('block', b.block, 'string', a.s, 'depth', a.d))))"""
    states = lines.selectExpr("src_file", f"{folded} AS f")
    # The reader's last piece had no brace behind it; the one added closes a level too many.
    return states.selectExpr("src_file", "f.s = 0 AND f.d = -1 AS complete", "inline(f.seen)")


def _cut_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts between the cuts of a range: number ``k`` of cuts before each, and all ``cuts`` with the last one."""
    key, string, depth, k, rest = None, 0, 0, 0, b""
    for new, data, row in _blocks(batches):
        if new != key:
            if key is not None:
                yield _piece_rows(key, [(k, rest, k)])
            key, string, depth, k, rest = new, row["string"], row["depth"], 0, b""
        raw, quotes = _marks(data)
        inside = (np.cumsum(quotes) - quotes + string) % 2 == 1
        step = np.where(inside, 0, _OPEN[raw].astype(np.int64) - _CLOSE[raw])
        after = depth + np.cumsum(step)
        cuts = np.flatnonzero(~inside & (((raw == 44) & (after == 1)) | ((raw == 91) & (after == 1) & (step == 1)) | ((raw == 93) & (after == 0) & (step == -1))))
        rows, at = [], 0
        for cut in cuts.tolist():
            rows.append((k, rest + data[at:cut], None))
            rest, at, k = b"", cut + 1, k + 1
        rest += data[at:]
        string, depth = (string + int(quotes.sum())) % 2, int(after[-1])
        if rows:
            yield _piece_rows(key, rows)
    if key is not None:
        yield _piece_rows(key, [(k, rest, k)])


def _piece_rows(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
    ks, texts, cuts = zip(*rows, strict=True)
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array(ks, pa.int64()), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()),
         pa.array(cuts, pa.int64())], [c.split()[0] for c in _PIECES.split(", ")],
    )


def array_elements(pieces: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(value, src_file, line_id) of every element of array files, of all or of those in ``files``; ``line_id`` is the element's number in its file.

    Of a file that ends inside a string or an element there is one row instead: its name.
    """
    states = block_states(pieces)
    if files is not None:
        states = states.join(files, "src_file", "left_semi")
    # One row per byte range, some ten thousand per TB; a broadcast join keeps the pieces in order.
    cut = pieces.join(F.broadcast(states.where("complete")), ["src_file", "block"]).mapInArrow(_cut_pass, _PIECES)
    upto = cut.where("cuts IS NOT NULL").selectExpr(
        "src_file", "block", "cuts AS n", "coalesce(sum(cuts) OVER (PARTITION BY src_file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto",
        "block = max(block) OVER (PARTITION BY src_file) AS final",
    )
    numbered = cut.join(F.broadcast(upto), ["src_file", "block"]).selectExpr(
        # Behind the file's last piece no brace was taken away.
        "src_file", "block", "upto + k AS line_id", "k = 0 OR k = n AS at_border", "IF(final AND k = n, left(text, length(text) - 1), text) AS text",
    )
    joined = numbered.where("at_border").groupBy("src_file", "line_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(block, text))), x -> x.text), '') AS text")
    )
    whole = numbered.where("NOT at_border").select("src_file", "line_id", "text").unionByName(joined)
    broken = states.where("NOT complete").select(F.col("src_file").alias("value"), "src_file", F.lit(0).cast("bigint").alias("line_id")).distinct()
    texts = whole.select(F.trim(F.translate("text", "\n\r\t﻿", "   ")).alias("value"), "src_file", "line_id").where("value <> ''")
    return texts.unionByName(broken)
