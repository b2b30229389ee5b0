"""Token counts of whole texts, huge ones by overlapping chunks that are spliced again.

A document of up to ``chunk`` characters is counted in place. A longer one becomes rows of
overlapping chunks, so that its chunks spread over tasks. Each chunk is encoded with
offsets and reports, for the overlaps with its neighbours, where a word begins right
behind white space and how many tokens it has before that place. White space ends every
word and no normalisation reaches across it, so the tokens behind such a place do not
depend on what stands before it: two neighbours that both report it can be spliced there.
Documents with an overlap that has no common place go round again with an overlap eight
times as wide (and chunks at least twice as wide as that), at last as one chunk.

* ``text`` null or empty: 0 tokens, 0 bytes. Repeated rows each get a row; equal or null
  ids are told apart by an inner row key. Empty table: no rows.
* Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm import wordbpe
from emberwatch.llm.texts import ddl_of, text_slices
from emberwatch.sources.store import materialize

CHUNK = 65_536
OVERLAP = 512
WIDEN = 8
_PLACE = re.compile(rf"[{wordbpe.SPACES}](?=[^{wordbpe.SPACES}])")


def _count_whole(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(vocabulary)
        for batch in batches:
            for part in text_slices(batch):
                counts = [len(x) // 4 for x in bpe.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"]
                )

    return run


def places_and_counts(bpe: wordbpe.WordBpe, text: str, spans: list[tuple[int, int]]) -> tuple[list[list[int]], list[list[int]], int]:
    """For each span of a text: where a word begins behind white space, and the tokens before it; and all tokens."""
    cuts: list[list[int]] = [[m.end() for m in _PLACE.finditer(text, a, b)] for a, b in spans]
    order = sorted({c for found in cuts for c in found})
    edges = [0, *order, len(text)]
    sizes = [len(x) // 4 for x in bpe.encode([text[a:b] for a, b in zip(edges, edges[1:], strict=False)])]
    before = dict(zip(order, np.cumsum(sizes)[:-1].tolist(), strict=True)) if order else {}
    return cuts, [[before[c] for c in found] for found in cuts], sum(sizes)


def _count_chunks(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(vocabulary)
        for batch in batches:
            for row in batch.to_pylist():
                text, overlap, at = row["text"], row["overlap"], row["start"]
                left = (0, min(overlap, len(text))) if row["chunk_no"] else (0, 0)
                right = (max(0, len(text) - overlap), len(text)) if not row["last"] else (0, 0)
                (a, b), (na, nb), total = places_and_counts(bpe, text, [left, right])
                yield pa.RecordBatch.from_pylist(
                    [{
                        "row_key": row["row_key"], "chunk_no": row["chunk_no"], "total": total,
                        "left_places": [at + x for x in a], "left_counts": na,
                        "right_places": [at + x for x in b], "right_counts": nb,
                    }],
                    schema=_CHUNK_ARROW,
                )

    return run


_CHUNK_DDL = (
    "row_key string, chunk_no bigint, total bigint, left_places array<bigint>, left_counts array<bigint>, "
    "right_places array<bigint>, right_counts array<bigint>"
)
_CHUNK_ARROW = pa.schema(
    [("row_key", pa.string()), ("chunk_no", pa.int64()), ("total", pa.int64())]
    + [(f"{side}_{what}", pa.list_(pa.int64())) for side in ("left", "right") for what in ("places", "counts")]
)


def _splice(chunks: DataFrame) -> DataFrame:
    """(row_key, n_tokens); null where some overlap has no common place.

    A chunk counts from its splice place with the chunk before to that with the chunk
    after. Neighbours meet by a join on (row_key, chunk_no); sums are combined map-side.
    """
    right = chunks.select("row_key", (F.col("chunk_no") + 1).alias("chunk_no"), "right_places", "right_counts")
    left = chunks.where("chunk_no > 0").select("row_key", "chunk_no", "left_places", "left_counts")
    place = F.array_min(F.array_intersect("left_places", "right_places"))
    met = left.join(right, ["row_key", "chunk_no"]).select(
        "row_key",
        (
            F.get("right_counts", F.array_position("right_places", place).cast("int") - 1)
            - F.get("left_counts", F.array_position("left_places", place).cast("int") - 1)
        ).alias("part"),
    )
    # total_i counts everything; at a seam the tokens behind it in the left chunk and
    # before it in the right chunk drop out: + right_count - total for the left one.
    parts = met.select("row_key", "part", F.lit(1).alias("seam")).unionByName(
        chunks.select("row_key", F.lit(0).cast("bigint").alias("part"), F.lit(0).alias("seam"))
    )
    seams = parts.groupBy("row_key").agg(
        F.sum("part").alias("at_seams"), F.max(F.col("part").isNull()).alias("failed")
    )
    ends = chunks.groupBy("row_key").agg(F.max_by("total", "chunk_no").alias("last_total"))
    return seams.join(ends, "row_key").select(
        "row_key", F.when(~F.col("failed"), F.col("at_seams") + F.col("last_total")).alias("n_tokens")
    )


def _chunked(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Overlapping chunks (start every ``chunk - overlap`` characters) dealt evenly over the tasks."""
    step = chunk - overlap
    count = F.greatest(F.lit(1), F.ceil((F.col("n_chars") - overlap) / step)).cast("int")
    rows = long.select("row_key", "text", count.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    return rows.select(
        "row_key", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.lit(overlap).alias("overlap"),
        (F.col("chunk_no").cast("bigint") * step).alias("start"), (F.col("chunk_no") == F.col("n") - 1).alias("last"),
        F.expr(f"substring(text, chunk_no * {step} + 1, {chunk})").alias("text"),
    ).repartition("row_key", "chunk_no")


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: id, ``n_bytes`` (UTF-8) and ``n_tokens``."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    narrow = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    kind = ddl_of(docs, id_column)
    small = narrow.where(F.char_length("text") <= chunk).mapInArrow(
        _count_whole(vocabulary), f"id {kind}, n_bytes bigint, n_tokens bigint"
    )
    huge = materialize(
        narrow.where(F.char_length("text") > chunk).select("*", F.char_length("text").alias("n_chars"), F.expr("uuid()").alias("row_key")),
        "long-texts",
    )
    done, todo = [small], huge
    while todo.take(1):
        counted = _chunked(todo, chunk, overlap).mapInArrow(_count_chunks(vocabulary), _CHUNK_DDL)
        spliced = materialize(_splice(materialize(counted, "chunk-counts")), "spliced")
        joined = todo.join(spliced, "row_key")
        done.append(joined.where("n_tokens IS NOT NULL").select("id", "n_bytes", "n_tokens"))
        todo = materialize(joined.where("n_tokens IS NULL").drop("n_tokens"), "wider")
        overlap *= WIDEN
        chunk = max(chunk, 2 * overlap)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("id", id_column)
