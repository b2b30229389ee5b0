"""Language of whole texts by a linear-chain conditional random field over their words.

Every word gets scores from its beginnings and endings, its byte n-grams and a lexicon of
words seen in training; learned transitions tie neighbours together. Forward-backward
gives each word's probability of each language, so code-switched text is labelled word by
word; a document's language is the one with the largest expected share of words.

The model is fitted on the driver by gradient steps on the sequence likelihood, from a
bounded sample with an equal share for every label, cut into pieces that are spliced across languages so
that the transitions see switches. Labelling is a pure map over the documents.

Long texts need no long loop: words stand in blocks of 64 whose transfer matrices are
multiplied for all blocks at once, then block ends are chained, then blocks are filled in.

* Null text, or no Unicode letter: ``und`` with score 0 and no words. In other texts a word is
  a run of ASCII letters and characters beyond ASCII. Null labels are not learned from; with no
  labelled row every text is ``und``. One label only: texts with letters get it, score 1.
* Ties go to the label first in order. Very long texts are labelled whole. Repeated rows
  and null ids: one row each. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.texts import LETTER_LIKE, Substrings, ddl_of, runs, text_buffer, text_slices

SAMPLE_PER_LABEL = 200
SAMPLE_BYTES = 2_000_000
STRETCH = 2_000  # bytes of a piece of a long training text
SLOTS = 1 << 16
AFFIXES = (1, 2, 3)
LEXICON_MIN = 3
BLOCK = 64
PIECE = 40
UNKNOWN = "und"
LEAST_SCORE = 0.35  # below this score ``known_language`` rejects a text


@dataclass
class Crf:
    labels: list[str]
    bigrams: np.ndarray  # one table (SLOTS, labels) per feature family
    trigrams: np.ndarray
    affixes: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    words: np.ndarray  # scores of lexicon words; the last row is for words outside
    transitions: np.ndarray

    @classmethod
    def empty(cls, labels: list[str], lexicon: np.ndarray) -> Crf:
        k = len(labels)
        table = lambda n: np.zeros((n, k), np.float32)
        return cls(labels, table(SLOTS), table(SLOTS), table(SLOTS), lexicon, table(len(lexicon) + 1), np.eye(k, dtype=np.float32))

    def learned(self) -> bool:
        return any(table.any() for table in (self.bigrams, self.trigrams, self.affixes, self.words))


@dataclass
class Words:
    """Words of a buffer of texts and the slots of their features."""

    text_of: np.ndarray
    hashes: np.ndarray
    bigram_slots: np.ndarray
    bigram_starts: np.ndarray
    trigram_slots: np.ndarray
    trigram_starts: np.ndarray
    affix_slots: np.ndarray  # (words, 2 * len(AFFIXES))


def words_of(texts: pa.Array) -> Words:
    lowered, offsets = text_buffer(pc.utf8_lower(texts))
    member = LETTER_LIKE[lowered]
    starts, stops = runs(member, offsets)
    # Words only, one space before and behind each: n-grams see word edges but no neighbour.
    sizes = stops - starts
    first = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes + 2, out=first[1:])
    raw = np.full(int(first[-1]), 32, np.int64)
    inside = np.arange(int(sizes.sum())) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1
    raw[inside] = lowered[member]
    strings = Substrings(raw.astype(np.uint8))
    begin, end = first[:-1] + 1, first[1:] - 1
    keep2 = np.ones(max(len(raw) - 1, 0), bool)
    keep2[first[1:-1] - 1] = False
    keep3 = keep2[: len(raw) - 2].copy() if len(raw) > 2 else np.zeros(0, bool)
    if len(keep3):
        keep3[first[1:-1] - 2] = False
    bigrams = (raw[:-1] * 256 + raw[1:])[keep2]
    tri = ((raw[:-2] * 65536 + raw[1:-1] * 256 + raw[2:]) * 2654435761 >> 13 & (SLOTS - 1))[keep3] if len(keep3) else np.zeros(0, np.int64)
    affixes = []
    for n in AFFIXES:
        cut = np.minimum(n, sizes)
        affixes.append(strings.hash(begin, begin + cut) ^ np.uint64(2 * n))
        affixes.append(strings.hash(end - cut, end) ^ np.uint64(2 * n + 1))
    slots = np.stack(affixes, axis=1) if len(starts) else np.zeros((0, 2 * len(AFFIXES)), np.uint64)
    count2, count3 = sizes + 1, sizes
    return Words(
        np.searchsorted(offsets, starts, side="right") - 1, strings.hash(begin, end), bigrams, np.cumsum(count2) - count2,
        tri, np.cumsum(count3) - count3, (slots & np.uint64(SLOTS - 1)).astype(np.int64),
    )


def words_in_parts(texts: list[str], size: int = 100) -> Words:
    """Words of a list of texts, computed for ``size`` texts at a time to keep buffers small."""
    parts = [words_of(pa.array(texts[a : a + size], pa.string())) for a in range(0, len(texts), size)] or [words_of(pa.array([], pa.string()))]
    bi, tri = (np.cumsum([0, *[len(getattr(p, n)) for p in parts]]) for n in ("bigram_slots", "trigram_slots"))
    return Words(
        np.concatenate([p.text_of + k * size for k, p in enumerate(parts)]), np.concatenate([p.hashes for p in parts]),
        np.concatenate([p.bigram_slots.astype(np.int32) for p in parts]), np.concatenate([p.bigram_starts + b for p, b in zip(parts, bi, strict=False)]),
        np.concatenate([p.trigram_slots.astype(np.int32) for p in parts]), np.concatenate([p.trigram_starts + t for p, t in zip(parts, tri, strict=False)]),
        np.concatenate([p.affix_slots.astype(np.int32) for p in parts]),
    )


def emissions(model: Crf, w: Words) -> np.ndarray:
    """Scores (words, labels)."""
    if len(w.hashes) == 0:
        return np.zeros((0, len(model.labels)), np.float32)
    out = np.add.reduceat(model.bigrams[w.bigram_slots], w.bigram_starts, axis=0)
    out += np.add.reduceat(model.trigrams[w.trigram_slots], w.trigram_starts, axis=0)
    for column in range(w.affix_slots.shape[1]):
        out += model.affixes[w.affix_slots[:, column]]
    return out + model.words[lexicon_rows(model.lexicon, w.hashes)]


def lexicon_rows(lexicon: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if len(lexicon) == 0:
        return np.zeros(len(hashes), np.int64)
    at = np.searchsorted(lexicon, hashes)
    at[at == len(lexicon)] = 0
    return np.where(lexicon[at] == hashes, at, len(lexicon))


def marginals(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Probability of each label for each word; ``sizes`` are the words per text, in order."""
    return forward_backward(scores, sizes, transitions)[0]


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each label for each word, and the same given only the words up to it."""
    n, k = scores.shape
    if n == 0:
        return scores, scores
    blocks = -(-sizes // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    starts = np.cumsum(sizes) - sizes
    within = np.arange(n) - np.repeat(starts, sizes)
    place = (np.repeat(first_block, sizes) + within // BLOCK) * BLOCK + within % BLOCK
    p = np.ones((total * BLOCK, k), np.float32)
    p[place] = np.exp(scores - scores.max(axis=1, keepdims=True))
    real = np.zeros(total * BLOCK, bool)
    real[place] = True
    p, real = p.reshape(total, BLOCK, k), real.reshape(total, BLOCK)
    a = np.exp(transitions - transitions.max()).astype(np.float32)

    product = np.broadcast_to(np.eye(k, dtype=np.float32), (total, k, k)).copy()
    for t in range(BLOCK):
        step = (product.reshape(-1, k) @ a).reshape(total, k, k) * p[:, t, None, :]
        step /= step.max(axis=(1, 2), keepdims=True)
        product = np.where(real[:, t, None, None], step, product)

    into = np.full((total, k), 1 / k, np.float32)  # forward vector before each block
    out_of = np.full((total, k), 1 / k, np.float32)  # backward vector behind each block
    order = np.argsort(-blocks, kind="stable")
    counts = blocks[order]
    for j in range(1, int(blocks.max())):
        rows = first_block[order[: np.searchsorted(-counts, -j)]] + j  # texts with more than j blocks
        v = np.einsum("nk,nkl->nl", into[rows - 1], product[rows - 1])
        into[rows] = v / v.sum(axis=1, keepdims=True)
    for j in range(2, int(blocks.max()) + 1):
        chosen = order[: np.searchsorted(-counts, -j, side="right")]
        rows = first_block[chosen] + blocks[chosen] - j
        v = np.einsum("nkl,nl->nk", product[rows + 1], out_of[rows + 1])
        out_of[rows] = v / v.sum(axis=1, keepdims=True)

    forward = np.empty((total, BLOCK, k), np.float32)
    v = into
    for t in range(BLOCK):
        step = (v @ a) * p[:, t]
        step /= step.sum(axis=1, keepdims=True)
        v = np.where(real[:, t, None], step, v)
        forward[:, t] = v
    past = forward.reshape(-1, k)[place]
    v = out_of
    for t in range(BLOCK - 1, -1, -1):
        forward[:, t] *= v
        step = (p[:, t] * v) @ a.T
        step /= step.sum(axis=1, keepdims=True)
        v = np.where(real[:, t, None], step, v)
    both = forward.reshape(-1, k)[place]
    return both / both.sum(axis=1, keepdims=True), past


def fit(texts: list[str], labels: list[str], rounds: int = 6, rate: float = 0.15, seed: int = 7) -> Crf:
    """Adagrad on the likelihood of pieces of ``PIECE`` words, half of them with a switch inside."""
    names = sorted(set(labels))
    k = len(names)
    code = np.array([names.index(x) for x in labels], np.int64)
    w = words_in_parts(texts)
    kinds, counts = np.unique(w.hashes, return_counts=True)
    model = Crf.empty(names, kinds[counts >= LEXICON_MIN])
    if k < 2 or len(w.hashes) < 2 * PIECE:
        return model
    rng = np.random.default_rng(seed)
    sizes = np.bincount(w.text_of, minlength=len(texts))
    first = np.cumsum(sizes) - sizes
    # A label's texts of a piece's length; if it has none, its shorter ones.
    by_label = [g if len(g := np.flatnonzero((code == c) & (sizes >= PIECE))) else np.flatnonzero((code == c) & (sizes > 0)) for c in range(k)]
    by_label = [g for g in by_label if len(g)]
    row_of = lexicon_rows(model.lexicon, w.hashes)
    bi_n = np.diff(np.append(w.bigram_starts, len(w.bigram_slots)))
    tri_n = np.diff(np.append(w.trigram_starts, len(w.trigram_slots)))
    seen = {n: np.full(getattr(model, n).shape, 1e-2, np.float32) for n in ("bigrams", "trigrams", "affixes", "words", "transitions")}

    def descend(name: str, slots: np.ndarray, error: np.ndarray) -> None:
        table = getattr(model, name)
        grad = np.stack([np.bincount(slots, error[:, c], minlength=len(table)) for c in range(k)], axis=1).astype(np.float32)
        seen[name] += grad**2
        table -= rate * grad / np.sqrt(seen[name])

    def spread(starts: np.ndarray, counts_: np.ndarray) -> np.ndarray:
        total = int(counts_.sum())
        return np.repeat(starts - (np.cumsum(counts_) - counts_), counts_) + np.arange(total)

    def piece(length: int) -> np.ndarray:
        group = by_label[rng.integers(len(by_label))]
        text = group[rng.integers(len(group))]
        at = first[text] + rng.integers(max(1, sizes[text] - length + 1))
        return np.arange(at, min(at + length, first[text] + sizes[text]))

    for _ in range(rounds * 40):
        chosen = []
        for s in range(128):
            cut = int(rng.integers(5, PIECE - 5)) if s % 2 else PIECE
            parts = [piece(cut)] + ([piece(PIECE - cut)] if s % 2 else [])
            chosen.append(np.concatenate(parts))
        lengths = np.array([len(c) for c in chosen])
        at = np.concatenate(chosen)
        gold = code[w.text_of[at]]
        bi = spread(w.bigram_starts[at], bi_n[at])
        tri = spread(w.trigram_starts[at], tri_n[at])
        part = Words(w.text_of[at], w.hashes[at], w.bigram_slots[bi], np.cumsum(bi_n[at]) - bi_n[at], w.trigram_slots[tri],
                     np.cumsum(tri_n[at]) - tri_n[at], w.affix_slots[at])
        scores = emissions(model, part)
        prob, past = forward_backward(scores, lengths, model.transitions)
        error = prob.copy()
        error[np.arange(len(at)), gold] -= 1
        descend("bigrams", part.bigram_slots, np.repeat(error, bi_n[at], axis=0))
        descend("trigrams", part.trigram_slots, np.repeat(error, tri_n[at], axis=0))
        for column in range(part.affix_slots.shape[1]):
            descend("affixes", part.affix_slots[:, column], error)
        descend("words", row_of[at], error)
        # Transitions: observed pairs against expected ones.
        ends = np.cumsum(lengths) - 1
        pair = np.ones(len(at), bool)
        pair[ends] = False
        i = np.flatnonzero(pair)
        expected = pair_marginals(prob, past, model.transitions, i)
        observed = np.bincount(gold[i] * k + gold[i + 1], minlength=k * k).reshape(k, k)
        grad = ((expected - observed) / len(i)).astype(np.float32)
        seen["transitions"] += grad**2
        model.transitions -= rate * grad / np.sqrt(seen["transitions"])
    return model


def pair_marginals(prob: np.ndarray, past: np.ndarray, transitions: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Expected number of label pairs at the words ``i`` and those behind them.

    Given the label behind it, a word's label depends on the words up to it only: forward
    probability times transition, scaled to one, times the probability of the label behind.
    """
    joint = past[i][:, :, None] * np.exp(transitions - transitions.max())[None]
    joint /= joint.sum(axis=1, keepdims=True)
    return (joint * prob[i + 1][:, None, :]).sum(axis=0)


def labelled_sample(docs: DataFrame, learn_from: F.Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang",
                    per_label: int = SAMPLE_PER_LABEL) -> tuple[list[str], list[str]]:
    """At most ``per_label`` texts of each label, those with the least id hashes, in an equal share of ``SAMPLE_BYTES`` per label.

    If a label's texts do not fit its share, the longest ones are cut to one common length: pieces of about
    ``STRETCH`` bytes at hashed places all over the text. So no text and no label takes from another.
    """
    usable = docs.where(F.col(label_column).isNotNull() & F.col(text_column).isNotNull() & F.col(id_column).isNotNull() & learn_from)
    counts = {r[0]: r[1] for r in usable.groupBy(label_column).count().collect()}
    if not counts:
        return [], []
    order = F.xxhash64(F.lit("sample"), F.col(id_column))
    raw = F.col(text_column).cast("binary")
    rows = usable.select(F.col(label_column).alias("label"), order.alias("o"), F.xxhash64(raw).alias("h"), F.octet_length(raw).alias("n"), raw.alias("raw"))
    first = Window.partitionBy("label").orderBy("o", "h", "n")

    def of_label(values: dict) -> F.Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("label"))

    def chosen(bounds: dict[str, float], *columns: F.Column) -> list:
        near = rows.where((F.col("o").cast("double") + 2.0**63) / 2.0**64 <= of_label(bounds)).where(F.col("label").isin(*bounds))
        return near.select("label", "o", "h", "n", *columns).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_label).collect()

    # The expected number of candidates is twice the sample. Only many rows of one id can leave fewer: then all are candidates.
    bounds = {name: min(1.0, 2 * per_label / n) for name, n in counts.items()}
    found = chosen(bounds)
    got = Counter(r.label for r in found)
    scarce = {name: 1.0 for name, n in counts.items() if got[name] < min(per_label, n)}
    if scarce:
        bounds |= scarce
        found = [r for r in found if r.label not in scarce] + chosen(scarce)
    sizes: dict[str, list[int]] = {}
    for r in found:
        sizes.setdefault(r.label, []).append(r.n)
    caps = {name: common_length(n, max(1, SAMPLE_BYTES // len(counts))) for name, n in sizes.items()}
    picked = sorted(chosen(bounds, _pieces(of_label(caps)).alias("pieces")), key=lambda r: (r.o, r.label, r.h))
    return [" ".join(bytes(x).decode("utf-8", "ignore") for x in r.pieces) for r in picked], [r.label for r in picked]


def common_length(sizes: list[int], share: int) -> int:
    """The largest length to which all longer texts can be cut so that the sum is at most ``share``; one byte at least."""
    left = share
    for k, n in enumerate(sorted(sizes)):
        level = left // (len(sizes) - k)
        if n > level:
            return max(1, level)
        left -= n
    return max(1, *sizes)


def _pieces(cap: F.Column) -> F.Column:
    """Binary pieces of ``raw``: the whole, or of each equal stretch one piece at a hashed place, with a byte each for a space between them."""
    count = F.greatest(F.lit(1), cap.cast("bigint") / STRETCH).cast("int")
    stretch, size = (F.col("n") / count).cast("int"), F.greatest(F.lit(1), (cap / count).cast("int") - F.when(count > 1, 1).otherwise(0))

    def piece(k: F.Column) -> F.Column:
        at = k * stretch + F.pmod(F.xxhash64(F.col("o"), F.col("h"), k), stretch - size + 1)
        return F.substring(F.col("raw"), at.cast("int") + 1, size)

    return F.when(F.col("n") <= cap, F.array("raw")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), piece))


def has_letter(texts: pa.Array) -> pa.Array:
    """Whether a text has a Unicode letter; signs, digits and emoji beyond ASCII are none."""
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)


def _predict(m: Crf, texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, Words, np.ndarray]:
    """Language, score, words and switches per text; the words and their most likely labels. No letter, no words."""
    n = len(texts)
    letters = has_letter(texts)
    if not all(letters.to_numpy(zero_copy_only=False)):
        texts = pc.if_else(letters, texts, pa.scalar("", texts.type))
    w = words_of(texts)
    sizes = np.bincount(w.text_of, minlength=n)
    k = len(m.labels)
    prob = marginals(emissions(m, w), sizes[sizes > 0], m.transitions) if k else np.zeros((0, 0))
    some = (sizes > 0) & (k > 0)
    share = np.zeros((n, max(1, k)))
    for c in range(k):
        share[:, c] = np.bincount(w.text_of, prob[:, c], minlength=n)
    share /= np.maximum(sizes, 1)[:, None]
    names = np.array([*m.labels, UNKNOWN], object)
    best = np.where(some, share.argmax(axis=1), k)
    score = np.where(some, np.clip(share.max(axis=1), 0, 1), 0.0)
    top = prob.argmax(axis=1) if len(prob) else np.zeros(0, np.int64)
    turns = np.zeros(n, np.int64)
    if len(top):
        turn = (top[1:] != top[:-1]) & (w.text_of[1:] == w.text_of[:-1])
        turns = np.bincount(w.text_of[1:][turn], minlength=n)
    return pa.array(names[best].tolist(), pa.string()), pa.array(score), sizes, turns, w, top


def label_texts(docs: DataFrame, model: Crf, id_column: str = "doc_id", text_column: str = "text", spans: bool = False) -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score``, ``n_words``, ``n_switches``; with ``spans`` also the
    runs of words of one language as ``spans`` array<struct<first_word, stop_word, lang>>."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("first_word", pa.int64()), ("stop_word", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in text_slices(batch):
                lang, score, sizes, turns, w, top = _predict(m, part.column("text"))
                columns = [part.column("id"), lang, score, pa.array(sizes), pa.array(turns)]
                if spans:
                    columns.append(pa.array(_spans(top, w.text_of, part.num_rows, m.labels), span_type))
                yield pa.RecordBatch.from_arrays(columns, names=out_names)

    out_names = [id_column, "lang_pred", "score", "n_words", "n_switches", *["spans"] * spans]
    ddl = f"`{id_column}` {ddl_of(docs, id_column)}, lang_pred string, score double, n_words bigint, n_switches bigint"
    ddl += ", spans array<struct<first_word: bigint, stop_word: bigint, lang: string>>" * spans
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, ddl)


def known_language(docs: DataFrame, model: Crf, text_column: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and a main language, unchanged and without a shuffle.

    A text has none if the model gives no language ``least`` of its words, as in a mix of all of them. A
    model that has learned nothing rejects no text with letters, nor does one of a single language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        learned = m.learned()
        for batch in batches:
            for part in text_slices(batch, f"c{at}"):
                keep = has_letter(part.column(at))
                if learned:
                    keep = pc.and_(keep, pc.greater_equal(_predict(m, part.column(at))[1], least))
                yield part.filter(keep)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def _spans(top: np.ndarray, text_of: np.ndarray, n: int, labels: list[str]) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n)]
    if len(top) == 0:
        return out
    edge = np.flatnonzero((top[1:] != top[:-1]) | (text_of[1:] != text_of[:-1])) + 1
    starts, stops = np.concatenate([[0], edge]), np.concatenate([edge, [len(top)]])
    base = np.searchsorted(text_of, text_of[starts])
    for s, e, b in zip(starts.tolist(), stops.tolist(), base.tolist(), strict=True):
        out[text_of[s]].append({"first_word": s - b, "stop_word": e - b, "lang": labels[top[s]]})
    return out


def identify(docs: DataFrame, learn_from: F.Column, id_column: str = "doc_id", text_column: str = "text",
             label_column: str = "lang", spans: bool = False) -> DataFrame:
    """Fits on the rows for which ``learn_from`` holds, then labels all documents."""
    return label_texts(docs, fit(*labelled_sample(docs, learn_from, id_column, text_column, label_column)), id_column, text_column, spans)
