"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet.

A is a byte-level BPE over space + text, B a SentencePiece model that adds the space itself.
Both cut the same bytes. Where both end, they cut the bytes into groups: the document with
fewer ends drives a galloping search (exponential steps, then bisection) into the longer
list. A link is an A and a B token whose byte ranges overlap; the ranks of an A token's two
ends in B's list give the B tokens it overlaps.

1. One pass encodes the texts, aligns them and writes per document its counts, the digest of
   its groups and its distinct linked id pairs with their number of links; each task also
   writes sums per id pair in packed rows.
2. The sums of all tasks are added per id pair.
3. A second pass over the written rows looks up every pair. The pair table is broadcast in
   shards of at most ``SHARD_PAIRS`` pairs (48 MB), one pass over the narrow rows each; the
   ids of both vocabularies bound their number, and as a rule there is one.

Texts are cut for the encoders at single spaces between two other visible ASCII characters,
which no token of either vocabulary spans; a text without such a place is encoded whole. A's
ids come from the rank file where it is given and all characters lie below U+0250 (both
libraries agree there, see the tests); other texts take the JSON file's own library.

* Null or empty text, or tokens whose joined bytes differ from space + text: no tokens; all
  numbers are 0 and ``groups_sha256`` is ''.
* Very long texts are encoded in parts and aligned as arrays of numbers.
* Ties: all pairs that share a B id's highest count are best. Repeated rows stay rows.
* Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from emberwatch.llm.texts import ddl_of, pack, text_slices, unpack
from emberwatch.sources.store import materialize

SHARD_PAIRS = 4_000_000
PART_CHARS = 1 << 16
FLUSH_PAIRS = 4_000_000
SLICE = 1 << 19
LATIN = "ɏ"
_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")


# -- tokens ------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: visible Latin-1 signs stand for themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenBytes:
    """Bytes of every token id, side by side, for joining and measuring whole id arrays."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.data[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Tokenizers:
    """Both encoders of a worker."""

    def __init__(self, byte_path: str, piece_path: str, ranks_path: str | None, pattern: str | None):
        import sentencepiece
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(byte_path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(byte_path, encoding="utf-8"))
        letters = _byte_letters()
        vocab = dict(spec["model"]["vocab"])
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for text, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
        self.a = TokenBytes(tokens)
        self.fast = None
        if ranks_path is not None:
            import tiktoken

            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, open(ranks_path, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b = TokenBytes([self._piece(i) for i in range(self.pieces.get_piece_size())])
        self.digits = {n: _digits(n) for n in (len(self.a.lengths), len(self.b.lengths))}

    def _piece(self, i: int) -> bytes:
        text = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(text[3:5], 16)])
        return text.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A over space + text and of B over the text."""
        parts, owner = [], []
        for k, text in enumerate(texts):
            cut = _parts(text)
            parts += cut
            owner += [k] * len(cut)
        a, b = [[] for _ in texts], [[] for _ in texts]
        for k, ids in zip(owner, self._bytes([" " + p for p in parts]), strict=True):
            a[k] = a[k] + ids if a[k] else ids
        for k, ids in zip(owner, self.pieces.encode(parts, out_type=int, num_threads=1), strict=True):
            b[k] = b[k] + ids if b[k] else ids
        return a, b

    def _bytes(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        rest = []
        for k, text in enumerate(texts):
            if self.fast is not None and (text.isascii() or max(text) <= LATIN):
                out[k] = self.fast.encode_ordinary(text)
            else:
                rest.append(k)
        if rest:
            for k, e in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out


def _parts(text: str) -> list[str]:
    """The text in parts of about ``PART_CHARS``, without the space it was cut at."""
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        found = _CUT.search(text, at + PART_CHARS)
        if found is None:
            break
        out.append(text[at : found.start()])
        at = found.end()
    return [*out, text[at:] if at else text]


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the ids below n (one row each) and their number."""
    text = np.array([str(i) for i in range(n)], dtype=bytes)
    table = text.view(np.uint8).reshape(n, -1)
    return table, (table > 0).sum(axis=1)


@lru_cache(maxsize=2)
def _tokenizers(*paths) -> Tokenizers:
    return Tokenizers(*paths)


# -- alignment ---------------------------------------------------------------------------


def gallop(needles: np.ndarray, stack: np.ndarray, stride: int = 64) -> np.ndarray:
    """Place of the first element of the sorted ``stack`` that is not below each of the sorted ``needles``.

    Every ``stride``-th needle is placed by bisection; the others start from the place of the
    one before them in doubling steps until they have passed their value, then bisect the last step.
    """
    low = np.repeat(np.searchsorted(stack, needles[::stride]), stride)[: len(needles)]
    step = np.ones(len(needles), np.int64)
    high = low.copy()
    n = len(stack)
    going = np.flatnonzero((high < n) & (stack[np.minimum(high, n - 1)] < needles)) if n else np.zeros(0, np.int64)
    while len(going):
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + step[going], n)
        step[going] *= 2
        at = high[going]
        going = going[(at < n) & (stack[np.minimum(at, n - 1)] < needles[going])]
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        below = stack[middle] < needles[open_]
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return high


def _ranks(ends_a: np.ndarray, ends_b: np.ndarray, doc_a: np.ndarray, doc_b: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every A end among the B ends and whether both end there; each document's shorter list drives."""
    rank, common = np.zeros(len(ends_a), np.int64), np.zeros(len(ends_a), bool)
    a_leads = np.bincount(doc_a, minlength=n_docs) <= np.bincount(doc_b, minlength=n_docs)
    for side in (True, False):
        in_a, in_b = np.flatnonzero(a_leads[doc_a] == side), np.flatnonzero(a_leads[doc_b] == side)
        if not len(in_a) or not len(in_b):
            continue
        a, b = ends_a[in_a], ends_b[in_b]
        if side:
            at = gallop(a, b)
            rank[in_a], common[in_a] = in_b[np.minimum(at, len(b) - 1)], b[np.minimum(at, len(b) - 1)] == a
        else:
            at = gallop(b, a)
            common[in_a[at[a[np.minimum(at, len(a) - 1)] == b]]] = True
            # The first B end not below an A end: B ends ranked by the A end they fall under, counted up.
            rank[in_a] = in_b[np.cumsum(np.bincount(at, minlength=len(a) + 1))[: len(a)] - common[in_a]]
    return rank, common


def align(ids_a: list[list[int]], ids_b: list[list[int]], tokens: Tokenizers):
    """Alignment of documents whose A and B tokens cover the same bytes.

    Returns numbers of tokens and groups per document, digests of the groups, and all links as (document, A id, B id).
    """
    n_docs = len(ids_a)
    n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
    a, b = (np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
    doc_a, doc_b = np.repeat(np.arange(n_docs), n_a), np.repeat(np.arange(n_docs), n_b)
    ends_a, ends_b = np.cumsum(tokens.a.lengths[a]), np.cumsum(tokens.b.lengths[b])
    rank, common = _ranks(ends_a, ends_b, doc_a, doc_b, n_docs)
    # A token's first B token: the one of the end before it, or the next if both ended there.
    first = np.concatenate([[0], (rank + common)[:-1]])[: len(rank)]
    width = rank - first + 1
    links_a = np.repeat(np.arange(len(a)), width)
    links_b = np.arange(int(width.sum())) + np.repeat(first - (np.cumsum(width) - width), width)
    n_groups = np.bincount(doc_a, common, n_docs).astype(np.int64)
    digests = _group_digests(a, b, doc_a, doc_b, rank, common, n_docs, tokens)
    return n_a, n_b, n_groups, digests, doc_a[links_a], a[links_a], b[links_b]


def _group_digests(a, b, doc_a, doc_b, rank, common, n_docs: int, tokens: Tokenizers) -> list[str]:
    """SHA-256 of each document's groups: ids joined by commas, A's and B's by a bar, groups by semicolons."""
    group_a = np.cumsum(common) - common
    last_b = rank[common]  # place of each group's last B token
    last_a = np.flatnonzero(common)
    order_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
    group_b = np.searchsorted(last_b, np.arange(len(b)))
    order_b = np.arange(len(b)) + (last_a + 1)[group_b]
    total = len(a) + len(b)
    lengths, mark = np.zeros(total, np.int64), np.full(total, ord(","), np.uint8)
    (table_a, size_a), (table_b, size_b) = tokens.digits[len(tokens.a.lengths)], tokens.digits[len(tokens.b.lengths)]
    lengths[order_a], lengths[order_b] = size_a[a], size_b[b]
    mark[order_a[last_a]] = ord("|")
    mark[order_b[last_b]] = ord(";")
    ends = np.cumsum(lengths + 1)
    out = np.zeros(int(ends[-1]) if total else 0, np.uint8)
    out[ends - 1] = mark
    at = ends - lengths - 1
    for order, ids, table, size in ((order_a, a, table_a, size_a), (order_b, b, table_b, size_b)):
        start, n = at[order], size[ids]
        for k in range(table.shape[1]):
            has = n > k
            out[start[has] + k] = table[ids[has], k]
    counts = np.bincount(doc_a, minlength=n_docs) + np.bincount(doc_b, minlength=n_docs)
    stops = np.concatenate([[0], ends])[np.cumsum(counts)]
    starts = np.concatenate([[0], stops[:-1]])
    data = out.tobytes()
    return [hashlib.sha256(data[s : e - 1]).hexdigest() for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]


# -- first pass --------------------------------------------------------------------------

_FIRST = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, keys binary, times binary"
_NAMES = [x.split()[0] for x in _FIRST.split(", ")]
WIDTH = 5  # bytes of a packed id pair and of its links
SUM_ROW = 200_000


class _Sums:
    """Links per id pair of a task, in packed rows without document columns."""

    def __init__(self, id_type: pa.DataType):
        self.id_type = id_type
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(at, np.concatenate(self.counts), len(keys)).astype(np.int64)
        self.keys, self.counts, self.size = [], [], 0
        for k in range(0, len(keys), SUM_ROW):
            packed = (pack(np.diff(keys[k : k + SUM_ROW], prepend=0), WIDTH), pack(counts[k : k + SUM_ROW], WIDTH))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, self.id_type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), *(pa.array([x], pa.binary()) for x in packed)],
                ["id", *_NAMES],
            )


def _first_pass(paths: tuple, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizers(*paths)
        sums = _Sums(id_type)
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                rows, keys, times = _aligned(part.column("text").to_pylist(), tokens)
                sums.add(keys, times)
                yield pa.RecordBatch.from_arrays([part.column("id"), *rows], ["id", *_NAMES])
                if sums.size >= FLUSH_PAIRS:
                    yield from sums.flush()
        yield from sums.flush()

    return run


def _aligned(texts: list[str | None], tokens: Tokenizers):
    """Columns of one row per text, and the slice's distinct id pairs with their number of links."""
    n = len(texts)
    some = [k for k, t in enumerate(texts) if t]
    ids_a, ids_b = tokens.encode([texts[k] for k in some])
    good, good_a, good_b = [], [], []
    for k, x, y in zip(some, ids_a, ids_b, strict=True):
        want = (" " + texts[k]).encode()
        if tokens.a.joined(np.array(x, np.int64)).tobytes() == want == tokens.b.joined(np.array(y, np.int64)).tobytes():
            good.append(k)
            good_a.append(x)
            good_b.append(y)
    numbers = np.zeros((4, n), np.int64)
    digests, keys_out, times_out = [""] * n, [b""] * n, [b""] * n
    all_keys, all_times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if good:
        n_a, n_b, n_groups, found, doc, a, b = align(good_a, good_b, tokens)
        numbers[:, good] = n_a, n_b, n_groups, np.bincount(doc, minlength=len(good))
        keys = a * len(tokens.b.lengths) + b
        bits = (len(tokens.a.lengths) * len(tokens.b.lengths)).bit_length()
        pairs, times = np.unique((doc << bits) | keys, return_counts=True)
        keys = pairs & ((1 << bits) - 1)
        stops = np.cumsum(np.bincount(pairs >> bits, minlength=len(good)))
        for k, digest, start, stop in zip(good, found, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            digests[k] = digest
            keys_out[k] = pack(np.diff(keys[start:stop], prepend=0), WIDTH)
            times_out[k] = pack(times[start:stop], WIDTH)
        all_keys, at = np.unique(keys, return_inverse=True)
        all_times = np.bincount(at, times, len(all_keys)).astype(np.int64)
    rows = [*(pa.array(x) for x in numbers), pa.array(digests, pa.string()), pa.array(keys_out, pa.binary()), pa.array(times_out, pa.binary())]
    return rows, all_keys, all_times


# -- sums and lookup ---------------------------------------------------------------------


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, times in zip(batch.column("keys").to_pylist(), batch.column("times").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.cumsum(unpack(keys, WIDTH)).astype(np.int64)), pa.array(unpack(times, WIDTH).astype(np.int64))], ["pair", "links"]
            )


def pair_counts(sums: DataFrame, n_b: int) -> DataFrame:
    """(pair, links, best): links of every id pair of the corpus, and whether they are the most of its B id."""
    rows = sums.select("keys", "times").mapInArrow(_unpacked, "pair bigint, links bigint")
    added = materialize(rows.groupBy("pair").agg(F.sum("links").alias("links")), "pair-links")
    by_b = added.withColumn("b", F.expr(f"pair % {n_b}"))
    most = by_b.groupBy("b").agg(F.max("links").alias("most"))  # one row per id of B at most
    return by_b.join(F.broadcast(most), "b").selectExpr("pair", "links", "links = most AS best")


def _lookup(shard):
    """Adds the links of a shard's pairs to ``n_best`` and ``count_sum``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, links, best = shard.value
        for batch in batches:
            added = []
            for keys, times in zip(batch.column("keys").to_pylist(), batch.column("times").to_pylist(), strict=True):
                keys = np.cumsum(unpack(keys, WIDTH)).astype(np.int64)
                times = unpack(times, WIDTH).astype(np.int64)
                at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
                times = np.where(pairs[at] == keys, times, 0)
                added.append((int(times @ best[at]), int(times @ links[at])))
            columns = {n: batch.column(n) for n in batch.schema.names}
            for k, n in enumerate(("n_best", "count_sum")):
                columns[n] = pa.array(batch.column(n).to_numpy(zero_copy_only=False) + np.array([x[k] for x in added], np.int64))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def aligned_documents(docs: DataFrame, byte_path: str, piece_path: str, ranks_path: str | None = None, pattern: str | None = None,
                      id_column: str = "doc_id", text_column: str = "text", shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    paths = (byte_path, piece_path, ranks_path, pattern)
    tokens = _tokenizers(*paths)
    n_a, n_b = len(tokens.a.lengths), len(tokens.b.lengths)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = to_arrow_type(rows.schema["id"].dataType)
    first = materialize(rows.mapInArrow(_first_pass(paths, kind), f"id {ddl_of(docs, id_column)}, {_FIRST}"), "aligned")
    counts = materialize(pair_counts(first.where("n_a IS NULL"), n_b), "pair-counts")
    out = first.where("n_a IS NOT NULL").withColumns({c: F.lit(0).cast("bigint") for c in ("n_best", "count_sum")})
    shards = _shards(counts, counts.count(), shard_pairs, n_a * n_b)
    for k, (low, high) in enumerate(shards):
        table = counts.where(f"pair > {low} AND pair <= {high}").toArrow()
        order = np.argsort(table.column("pair").to_numpy())
        shard = tuple(np.ascontiguousarray(table.column(c).to_numpy()[order]) for c in ("pair", "links", "best"))
        if len(shard[0]):
            shared = docs.sparkSession.sparkContext.broadcast(shard)
            out = out.mapInArrow(_lookup(shared), out.schema)
            if k + 1 < len(shards):
                out = materialize(out, "looked-up")
                shared.unpersist()
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").withColumnRenamed("id", id_column)


def _shards(counts: DataFrame, n_pairs: int, shard_pairs: int, top: int) -> list[tuple[int, int]]:
    """Bounds (low, high] of ranges of id pairs with about ``shard_pairs`` pairs each."""
    n = -(-n_pairs // shard_pairs)
    if n <= 1:
        return [(-1, top)] * n
    inner = counts.agg(F.percentile_approx("pair", [i / n for i in range(1, n)], 100_000).alias("e")).first().e
    edges = [-1, *sorted(set(inner)), top]
    return list(zip(edges, edges[1:], strict=False))
