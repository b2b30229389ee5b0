"""BPE encoding and decoding of whole texts (speculate and verify, see ``wordbpe``).

A pure map over the documents: no shuffle, state is one bounded word cache per worker.

* ``text`` null or empty: no ids, ``decoded`` empty. Texts of any length are encoded whole.
* Repeated rows and equal ids: every row gets its own result row. Empty table: no rows.
* Other columns are ignored, whatever their names; the id column may hold nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm import wordbpe
from emberwatch.llm.texts import ddl_of, text_slices

SLICE_BYTES = 1 << 20


def encode_decode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids`` (little-endian 32-bit) and ``decoded``.

    ``vocabulary`` is a `tokenizers` file present on every executor.
    """
    schema = f"`{id_column}` {ddl_of(docs, id_column)}, n_tokens bigint, ids binary, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(vocabulary)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                ids = bpe.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([bpe.decode(x) for x in ids], pa.string()),
                    ],
                    [id_column, "n_tokens", "ids", "decoded"],
                )

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(run, schema)


def token_digests(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Digest form: SHA-256 of the ids and of the decoded text."""
    return encoded.select(
        id_column,
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )
