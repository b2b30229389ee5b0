"""Phrase collocations: contiguous phrases of two and three words that occur together more than their parts suggest.

1. Levels are filtered first as Apriori allows. Words that surely occur less than
   ``MIN_COUNT`` times are told by slot counts, then pairs of frequent neighbours, then
   triples of two frequent pairs, so only what may be frequent is a candidate.
2. One text pass counts the candidates: tasks merge theirs and send distinct word hashes with
   counts in packed rows, dealt by the phrase's hash; no phrase's text is sent. A part holds
   what ``PART_BYTES`` of text can give, and a phrase has a place in it per flush of a task.
3. Counts of first and last parts are joined by Spark, scores are exact 38-digit numbers
   (up to counts of 10**15), and each language's best are kept, all ties with the last included.
4. These are dealt into shards of about ``SHARD_PHRASES``. A shard is a double-array trie over
   the bytes of word numbers: from state s, byte d leads to base[s] + d if check[base[s] + d] = s.
   It is broadcast (about 100 bytes a phrase), the states of all positions of a text slice
   advance together, and where one reaches a phrase its words are read. One text pass a shard:
   their number follows from what is returned, not from the texts.

Words are told apart by 64 bits of hash, language included: of n distinct words some two are
taken for one with a chance of n**2 / 2**65, 3e-6 for ten million; phrases are likewise.

* Null language: ``und``. Null or empty text: no words. Very long texts are cut at piece
  ends, where no phrase goes on; a piece is read whole.
* Ties of scores are ordered by count, then by the phrase's bytes: no two rows are equal.
  Repeated rows count as often as they occur. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.slots import FLUSH, PACKED, Filter, SlotPlan, spread_join
from emberwatch.llm.texts import ASCII_LOWER, Substrings, byte_table, mix, pack, runs, text_buffer, unpack
from emberwatch.sources.store import materialize

MIN_COUNT = 10
MAX_WORDS = 3  # the key columns of candidates are made for three
TOP = 2_000
COVER_PERCENT = 50
SHARD_PHRASES = 1_000_000
MOST_HELD = 1_000_000  # phrases of one length a task holds; it sends them if more than half are distinct
PART_BYTES = 16 << 20
WINDOW = 1024  # bases that are tried at once when a trie is built
SLICE = 1 << 20
STATE = np.int32  # a shard's states are a few times its phrases

_ENDS = byte_table(b".,;:!?\n\x0b\x0c\r")
_WORD = ~(_ENDS | byte_table(b" \t"))
_STEP = np.uint64(0xA24BAED4963EE407)


# -- words -------------------------------------------------------------------------------


class Words:
    """Words of a slice of texts of several languages: hash, piece, byte range and row."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lang_hashes: np.ndarray):
        self.raw, self.lang_hashes = ASCII_LOWER[raw], lang_hashes
        self.starts, self.stops = runs(_WORD[self.raw], offsets)
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        ends = np.cumsum(_ENDS[self.raw])
        piece = ends[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        # A word goes on from the one before it if both stand in one piece of one text.
        self.follows = np.zeros(len(self.starts), bool)
        self.follows[1:] = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])
        self.hashes = mix(Substrings(self.raw).hash(self.starts, self.stops) ^ lang_hashes[self.row]) if len(self.starts) else np.zeros(0, np.uint64)

    def phrase(self, start: int, length: int) -> str:
        words = zip(self.starts[start : start + length], self.stops[start : start + length], strict=True)
        return b" ".join(self.raw[a:b].tobytes() for a, b in words).decode("utf-8", "replace")

    def neighbours(self, levels: int) -> list[np.ndarray]:
        """Positions from which phrases of 1, 2, ... words start."""
        n = len(self.starts)
        ok = np.ones(n, bool)
        out = [np.arange(n)]
        for k in range(1, levels):
            ok = ok[: max(0, n - k)] & self.follows[k:]
            out.append(np.flatnonzero(ok))
        return out


def joined(hashes: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from the hashes of their words."""
    out = hashes[0]
    for h in hashes[1:]:
        out = mix(out * _STEP + h)
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row) of about ``SLICE`` bytes; longer texts are cut behind piece ends."""
    raw, offsets = text_buffer(batch.column("text"))
    cuts, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row in np.flatnonzero(np.diff(offsets) > SLICE):
        ends = np.flatnonzero(_ENDS[raw[offsets[row] : offsets[row + 1]]]) + 1
        at = np.unique(np.searchsorted(ends, np.arange(SLICE, offsets[row + 1] - offsets[row], SLICE)))
        cuts.append(offsets[row] + ends[at[at < len(ends)]])
        rows.append(np.full(len(cuts[-1]), row))
    bounds, row = np.concatenate([offsets[:-1], *cuts]), np.concatenate([np.arange(batch.num_rows), *rows])
    order = np.lexsort((row, bounds))
    bounds, row = np.append(bounds[order], offsets[-1]), row[order]
    start = 0
    while start < len(row):
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + SLICE, side="right")) - 1)
        yield raw[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start], row[start:stop]
        start = stop


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """Words of slices and the language of each of their texts."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        packed = [np.frombuffer(n.encode(), np.uint8) for n in names]
        ends = np.cumsum([0, *map(len, packed)])
        hashes = Substrings(np.concatenate(packed)).hash(ends[:-1], ends[1:]) * _STEP
        number = {n: k for k, n in enumerate(names)}
        of_row = np.array([number[x] for x in langs])
        for raw, offsets, row in _slices(batch):
            yield Words(raw, offsets, hashes[of_row[row]]), [names[k] for k in of_row[row]]


# -- candidates --------------------------------------------------------------------------


def _level(words: Words, filters: list) -> list[np.ndarray]:
    """Positions of candidates of 1, 2, ... words; ``filters`` are those of the levels known so far, the last level has none yet."""
    found: list[np.ndarray] = []
    places = words.neighbours(len(filters) + 1)
    for n, at in enumerate(places, start=1):
        if found:
            alive = np.zeros(len(words.hashes) + 1, bool)
            alive[found[-1]] = True
            at = at[alive[at] & alive[at + 1]]  # both parts of one word less may be frequent
        if n <= len(filters):
            plan, often = filters[n - 1].value
            at = at[often(plan.slots(joined([words.hashes[at + k] for k in range(n)])))]
        found.append(at)
    return found


def _slot_pass(plan: SlotPlan, filters: list):
    """Slots of the phrases one word longer than the filters know, if all their parts pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for words, _ in _words(batches):
            at = _level(words, filters)[-1]
            held.append(joined([words.hashes[at + k] for k in range(len(filters) + 1)]))
            size += len(at)
            if size >= FLUSH:
                yield from plan.packed(held)
                held, size = [], 0
        if size:
            yield from plan.packed(held)

    return run


class _Counts:
    """Distinct phrases of ``n_words`` words with their counts, as a task merges them; with 0 words, words of each language."""

    def __init__(self, n_words: int, n_parts: int):
        self.n_words, self.n_parts = n_words, n_parts
        self.held: list[tuple[np.ndarray, ...]] = []  # (language number, count, hashes of the words)
        self.size = self.merged = 0

    def add(self, langs: np.ndarray, counts: np.ndarray | None, hashes: list[np.ndarray]) -> None:
        self.held.append(_distinct(langs, counts, hashes))
        self.size += len(self.held[-1][0])
        if self.size > MOST_HELD:
            self.merge()

    def merge(self) -> None:
        langs, counts, *hashes = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = [_distinct(langs, counts, hashes)]
        self.size = self.merged = len(self.held[0][0])

    def packed(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Packed rows of all that is held, each of one language and part; nothing is held any more."""
        if self.size:
            self.merge()
            langs, counts, *hashes = self.held[0]
            part = (joined(hashes) % np.uint64(self.n_parts)).astype(np.int32)
            order = np.lexsort((hashes[0], part, langs))
            langs, counts, part, hashes = langs[order], counts[order], part[order], [h[order] for h in hashes]
            new = (np.diff(part, prepend=-1) != 0) | (np.diff(langs, prepend=-1) != 0)
            edges = [*np.flatnonzero(new).tolist(), len(part)]
            rows = [
                (self.n_words, int(part[a]), names[langs[a]], pack(np.diff(hashes[0][a:b], prepend=np.uint64(0)), 8),
                 b"".join(h[a:b].tobytes() for h in hashes[1:]), pack(counts[a:b], 8))
                for a, b in zip(edges, edges[1:], strict=False)
            ]
            for k in range(0, len(rows), 64):
                columns = zip(*rows[k : k + 64], strict=True)
                types = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], [x.split()[0] for x in _PACKED.split(", ")])
        self.held, self.size, self.merged = [], 0, 0


def _distinct(langs: np.ndarray, counts: np.ndarray | None, hashes: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Every phrase once, with the sum of its counts (None: one each)."""
    if counts is None:
        _, first, sums = np.unique(joined(hashes), return_index=True, return_counts=True)
    else:
        _, first, at = np.unique(joined(hashes), return_index=True, return_inverse=True)
        sums = np.bincount(at, counts, len(first)).astype(np.int64)
    return langs[first], sums, *(h[first] for h in hashes)


_PACKED = "n_words int, part int, lang string, firsts binary, others binary, counts binary"
_PHRASE = "lang string, n_words int, key bigint, f bigint, h1 bigint, h2 bigint, h3 bigint, k12 bigint, k23 bigint"


def _count_pass(filters: list, n_parts: int):
    """Packed counts of all phrases that may be frequent, and of all words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [_Counts(n, n_parts) for n in range(MAX_WORDS + 1)]
        number: dict[str, int] = {}
        for words, langs in _words(batches):
            of_row = np.array([number.setdefault(x, len(number)) for x in langs])
            counts[0].add(of_row, np.bincount(words.row, minlength=len(langs)), [words.lang_hashes])
            for n, at in enumerate(_level(words, filters)[:MAX_WORDS], start=1):
                counts[n].add(of_row[words.row[at]], None, [words.hashes[at + k] for k in range(n)])
            for level in counts:
                if level.merged > MOST_HELD // 2:
                    yield from level.packed(list(number))
        for level in counts:
            yield from level.packed(list(number))

    return run


def _count_part(min_count: int):
    """Phrases of a part that occur often enough, with the keys of their first and last two words."""

    def run(table: pa.Table) -> pa.Table:
        n_words = table.column("n_words")[0].as_py()
        firsts = [np.cumsum(unpack(x.as_py(), 8)) for x in table.column("firsts")]
        others = [np.frombuffer(x.as_py(), "<u8").reshape(-1, len(h)) for x, h in zip(table.column("others"), firsts, strict=True)]
        counts = np.concatenate([unpack(x.as_py(), 8) for x in table.column("counts")]).astype(np.int64)
        langs = np.repeat(np.arange(len(firsts)), [len(h) for h in firsts])
        langs, f, *hashes = _distinct(langs, counts, [np.concatenate(firsts), *np.concatenate(others, axis=1)])
        often = np.flatnonzero(f >= (min_count if n_words else 0))
        h, none = [x[often] for x in hashes], pa.nulls(len(often), pa.int64())
        k12, k23 = ([joined(h[:2]), joined(h[1:])] if n_words == 3 else [None, None])
        columns = [joined(h), f[often], *h, *[None] * (MAX_WORDS - len(h)), k12, k23]
        return pa.table(
            [table.column("lang").take(pa.array(langs[often])), pa.array(np.full(len(often), n_words, np.int32)),
             *(none if x is None else pa.array(x.view(np.int64)) for x in columns)], [x.split()[0] for x in _PHRASE.split(", ")],
        )

    return run


# -- double-array tries ------------------------------------------------------------------


class Trie:
    """Double array over the digits (base 256) of word numbers: from state s, digit d leads to base[s] + d if check says s.

    State 0 is the root. A word takes as many digits as the alphabet's size asks for.
    """

    def __init__(self, alphabet: np.ndarray, base: np.ndarray, check: np.ndarray):
        self.alphabet, self.base, self.check = alphabet, base, check
        self.digits = digits_of(len(alphabet))
        self.near = np.zeros(1 << 16, bool)
        self.near[(alphabet & np.uint64(0xFFFF)).astype(np.int64)] = True

    @classmethod
    def build(cls, phrases: list[np.ndarray]) -> tuple[Trie, list[np.ndarray]]:
        """Trie of phrases and their beginnings, and each phrase's state; ``phrases[k]`` has rows of k + 1 word hashes."""
        alphabet = np.unique(np.concatenate([p.ravel() for p in phrases]))
        n = digits_of(len(alphabet))
        numbers = [np.searchsorted(alphabet, p) for p in phrases]
        codes = [np.concatenate([((x[:, [w]] >> (8 * np.arange(n)[::-1])) & 255).astype(np.uint8) for w in range(x.shape[1])], axis=1) for x in numbers]
        states = [np.zeros(len(x), np.int64) for x in numbers]
        places = _Places()
        for level in range(n * len(phrases)):
            deep = [k for k in range(len(phrases)) if n * (k + 1) > level]
            pairs = np.concatenate([states[k] * 256 + codes[k][:, level] for k in deep])
            steps, at = np.unique(pairs, return_inverse=True)
            del pairs
            children = places.add(steps // 256, steps % 256)[at]
            for k, part in zip(deep, np.split(children, np.cumsum([len(states[k]) for k in deep])[:-1]), strict=True):
                states[k] = part
        return cls(alphabet, *places.arrays()), states

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of hashed words, -1 for words of no phrase."""
        out = np.full(len(hashes), -1)
        near = np.flatnonzero(self.near[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.alphabet, hashes[near]), len(self.alphabet) - 1)
        out[near] = np.where(self.alphabet[at] == hashes[near], at, -1)
        return out

    def advance(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The state of every position one word on, -1 where the trie has none."""
        out = np.full(len(states), -1)
        live = np.flatnonzero((states >= 0) & (words >= 0))
        state, number = states[live], words[live]
        for k in range(self.digits - 1, -1, -1):
            to = self.base[state] + (number >> (8 * k) & 255)
            ok = self.check[to] == state
            live, state, number = live[ok], to[ok], number[ok]
        out[live] = state
        return out


def digits_of(n_words: int) -> int:
    return max(1, -(-max(1, n_words - 1).bit_length() // 8))


class _Places:
    """The two arrays of a trie while it grows; nodes with many children are placed first, each near the one before."""

    def __init__(self):
        self.used, self.base, self.check = np.zeros(1 << 16, bool), np.zeros(1 << 16, STATE), np.full(1 << 16, -1, STATE)
        self.used[:256] = True
        self.free_from = 256

    def _grow(self, size: int) -> None:
        if size > len(self.used):
            more = max(size, 2 * len(self.used)) - len(self.used)
            self.used, self.base = np.append(self.used, np.zeros(more, bool)), np.append(self.base, np.zeros(more, STATE))
            self.check = np.append(self.check, np.full(more, -1, STATE))

    def add(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """States of children (parent, code), which are sorted and distinct."""
        edges = np.append(np.flatnonzero(np.diff(parents, prepend=-1)), len(parents))
        width = np.diff(edges)
        out = np.zeros(len(parents), np.int64)
        cursor = self.free_from
        several = np.flatnonzero(width > 1)
        for g in several[np.argsort(-width[several], kind="stable")].tolist():
            own = codes[edges[g] : edges[g + 1]]
            start = self._fit(own, cursor)
            cursor = max(self.free_from, start)
            self.base[parents[edges[g]]] = start
            out[edges[g] : edges[g + 1]] = start + own
            self.used[start + own] = True
        single = edges[:-1][width == 1]
        self._grow(self.free_from + len(single) + int(self.used.sum()) + 256)
        at = np.flatnonzero(~self.used)[: len(single)]
        self.used[at] = True
        self.base[parents[single]], out[single] = at - codes[single], at
        self.check[out] = parents
        return out

    def _fit(self, codes: np.ndarray, at: int) -> int:
        """The first base from ``at`` on at which all codes fall on free places."""
        while True:
            self._grow(at + 256 + WINDOW)
            ok = np.ones(WINDOW, bool)
            for c in codes.tolist():
                ok &= ~self.used[at + c : at + c + WINDOW]
            if ok.any():
                return at + int(np.argmax(ok))
            at += WINDOW

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Both arrays as far as any step can lead."""
        size = int(max(np.flatnonzero(self.used)[-1], self.base.max())) + 257
        self._grow(size)
        return self.base[:size], self.check[:size]


def _build_shard(table: pa.Table) -> pa.Table:
    """A shard's trie in packed columns and the state of every phrase."""
    n_words = table.column("n_words").to_numpy()
    columns = [table.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("h1", "h2", "h3")]
    rows = [np.flatnonzero(n_words == n) for n in range(1, MAX_WORDS + 1)]
    trie, states = Trie.build([np.stack([c[r] for c in columns[:n]], axis=1) for n, r in enumerate(rows, start=1)])
    state = np.zeros(len(n_words), np.int64)
    for r, s in zip(rows, states, strict=True):
        state[r] = s
    packed = [trie.alphabet.tobytes(), trie.base.astype("<i4").tobytes(), trie.check.astype("<i4").tobytes()]
    head = {c: pa.nulls(1, t) for c, t in (("key", pa.int64()), ("state", pa.int64()))}
    body = {c: pa.nulls(len(state), pa.binary()) for c in ("alphabet", "base", "check")}
    shard = table.column("shard")[0].as_py()
    one = pa.table({"shard": pa.array([shard], pa.int32()), **head, **{c: pa.array([x], pa.binary()) for c, x in zip(body, packed, strict=True)}})
    many = pa.table({"shard": pa.array([shard] * len(state), pa.int32()), "key": table.column("key"), "state": pa.array(state), **body})
    return pa.concat_tables([one, many])


_BUILT = "shard int, key bigint, state bigint, alphabet binary, base binary, check binary"


def _read(shared):
    """Texts of the phrases whose states positions reach, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        seen = np.zeros(len(trie.check), bool)
        for words, _ in _words(batches):
            number = trie.numbers(words.hashes)
            states = np.zeros(len(number), np.int64)  # all positions at the root
            for level in range(MAX_WORDS):
                if level:
                    n = max(0, len(number) - level)
                    states = np.where(words.follows[level:], states[:n], -1)
                states = trie.advance(states, number[level:])
                alive = np.flatnonzero(states >= 0)
                if not len(alive):
                    break
                if level:
                    alive = alive[~seen[states[alive]]]
                    hit, first = np.unique(states[alive], return_index=True)
                    seen[hit] = True
                    texts = [words.phrase(k, level + 1) for k in alive[first].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(texts, pa.string())], ["state", "phrase"])

    return run


# -- the whole ---------------------------------------------------------------------------


def phrase_counts(texts: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(phrases of ``min_count`` or more with their count f, words n per lang); ``texts`` is (lang, text)."""
    share = texts.sparkSession.sparkContext.broadcast
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    filters: list = []
    for _ in range(MAX_WORDS):
        plan = SlotPlan(n_bytes // 4, min_count)
        slots = materialize(plan.frequent(texts.mapInArrow(_slot_pass(plan, filters), PACKED)), "frequent-slots")
        filters = [*filters, share((plan, Filter(slots, "slot", slots.count())))]
    packed = texts.mapInArrow(_count_pass(filters, 1 + n_bytes // PART_BYTES), _PACKED)
    counted = materialize(packed.groupBy("n_words", "part").applyInArrow(_count_part(min_count), _PHRASE), "phrases")
    return counted.where("n_words > 0"), counted.where("n_words = 0").selectExpr("lang", "f AS n")


def phrase_texts(texts: DataFrame, phrases: DataFrame, shard_phrases: int = SHARD_PHRASES) -> DataFrame | None:
    """(key, phrase) of ``phrases`` as they stand in the texts, or None if there are none."""
    n_shards = -(-phrases.count() // shard_phrases)
    if n_shards == 0:
        return None
    dealt = phrases.select(F.expr(f"cast(pmod(xxhash64(key), {n_shards}) as int) AS shard"), "key", "h1", "h2", "h3", "n_words")
    built = materialize(dealt.groupBy("shard").applyInArrow(_build_shard, _BUILT), "tries")
    found = None
    for k in range(n_shards):
        shard = built.where(F.col("shard") == k)
        packed = shard.where("alphabet IS NOT NULL").select("alphabet", "base", "check").first()
        if packed is None:
            continue
        trie = texts.sparkSession.sparkContext.broadcast(Trie(*(np.frombuffer(x, t) for x, t in zip(packed, ("<u8", "<i4", "<i4"), strict=True))))
        read = texts.mapInArrow(_read(trie), "state bigint, phrase string").groupBy("state").agg(F.min("phrase").alias("phrase"))
        part = shard.where("state IS NOT NULL").select("key", "state").join(materialize(read, "phrase-texts"), "state").select("key", "phrase")
        trie.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def collocations(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", min_count: int = MIN_COUNT,
                 top: int | None = TOP, shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases; ``top`` None gives all."""
    texts = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).alias("text")).where("text <> ''")
    phrases, langs = phrase_counts(texts, min_count)
    several = phrases.where("n_words > 1")
    cut = "array(struct(1 AS k, h1 AS left, IF(n_words = 2, h2, k23) AS right), struct(2 AS k, k12 AS left, h3 AS right))"
    cuts = several.selectExpr("key", "f AS a", f"inline(slice({cut}, 1, n_words - 1))")
    for end, name in (("left", "l"), ("right", "r")):
        part = phrases.select(F.col("key").alias(end), F.col("f").alias(name))
        cuts = spread_join(materialize(cuts, "cuts"), part, [end], "key")
    score = "(cast(1000000 as decimal(38, 0)) * a * a) div (cast(l as decimal(38, 0)) * r)"
    scored = cuts.selectExpr("key", f"struct({score} AS score, k, l, r) AS best").groupBy("key").agg(F.min("best").alias("best"))
    longer = several.where("n_words = 3").selectExpr("explode(array(k12, k23)) AS key", "f").groupBy("key").agg(F.max("f").alias("longer"))
    alone = several.join(longer, "key", "left").where(f"longer IS NULL OR 100 * longer < {COVER_PERCENT} * f")
    rows = alone.join(scored, "key").selectExpr("lang", "key", "n_words", "h1", "h2", "h3", "f AS a", "best.l", "best.r", "best.score")
    if top is not None:  # ties are ordered by the phrases, which are read only now
        rows = rows.selectExpr("*", "rank() OVER (PARTITION BY lang ORDER BY score DESC, a DESC) AS place").where(f"place <= {top}")
    best = materialize(rows, "best-phrases")
    named = phrase_texts(texts, best, shard_phrases)
    if named is None:
        ddl = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
        return docs.sparkSession.createDataFrame([], ddl)
    order = "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)"
    ranked = best.join(named, "key").selectExpr("*", f"cast({order} as bigint) AS rank")
    if top is not None:
        ranked = ranked.where(f"rank <= {top}")
    return ranked.join(langs, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
