"""Toxicity scores of whole texts by a counterfactually regularised linear classifier.

Features are the distinct words of a text and the beginnings of its words. From a bounded
sample of labelled rows the features that tell the labels apart are chosen by their
log-odds; a logistic model over them is fitted on the driver. Every sampled text with an
identity term also exists with that term swapped for each other term of its set; the
squared change of its score is penalised, so that a group's mere mention does not move
the score. Scoring is a pure map over the documents, without shuffle.

* Null or empty text, or none of the learned features: the score of an empty text.
* Labels that are null or without a document are not learned from. No labels at all, or
  one label only: that label's share is every text's score.
* Very long texts are scored whole. Repeated rows and equal or null ids: one row for each.
  Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.texts import LETTER_LIKE, Substrings, ddl_of, runs, text_buffer, text_slices

MAX_SAMPLE = 6_000
PREFIXES = (4, 5, 6, 7, 8)
MAX_FEATURES = 4_000
MIN_DOCUMENTS = 4
# Groups of terms that may stand for one another.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"], ["woman", "man", "girl", "boy"], ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "hispanic", "latino", "african"], ["immigrant", "refugee", "citizen", "foreigner"],
    ["immigrants", "refugees", "citizens", "foreigners"], ["deaf", "blind", "disabled", "autistic"],
]


def _hash_word(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Substrings(raw).hash(np.array([0]), np.array([len(raw)]))[0])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of every word and word beginning, repeats included."""
    raw, offsets = text_buffer(pc.utf8_lower(texts))
    starts, stops = runs(LETTER_LIKE[raw], offsets)
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    strings = Substrings(raw)
    hashes, owners = [strings.hash(starts, stops)], [text_of]
    for n in PREFIXES:
        long = stops - starts > n
        cut = starts[long] + n
        hashes.append(strings.hash(starts[long], cut) ^ np.uint64(n))
        owners.append(text_of[long])
    return np.concatenate(owners), np.concatenate(hashes)


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def found(self, owners: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, feature number)."""
        if len(self.hashes) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.hashes, hashes[hit])
        at[at == len(self.hashes)] = 0
        same = self.hashes[at] == hashes[hit]
        pairs = np.unique(owners[hit[same]] * len(self.hashes) + at[same])
        return pairs // len(self.hashes), pairs % len(self.hashes)

    def scores(self, texts: pa.Array) -> np.ndarray:
        owner, feature = self.found(*features(texts))
        z = self.bias + np.bincount(owner, self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def swapped(texts: list[str], groups: list[list[str]]) -> tuple[list[str], list[int]]:
    """Copies of texts with one identity term exchanged throughout, and the number of the text each stems from."""
    partner = {t: [o for o in g if o != t] for g in groups for t in g}
    out, origin = [], []
    for k, text in enumerate(texts):
        words = text.lower().split(" ")
        for term in sorted({w for w in words if w in partner}):
            for other in partner[term]:
                out.append(" ".join(other if w == term else w for w in words))
                origin.append(k)
    return out, origin


def fit(texts: list[str], labels: np.ndarray, groups: list[list[str]], penalty: float = 5.0, ridge: float = 0.02,
        steps: int = 400) -> Model:
    """Adam on log loss + ``penalty`` * mean squared score change under swaps + ``ridge`` * squared weights."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        z = np.log((share + 1e-6) / (1 - share + 1e-6))
        return Model(np.zeros(0, np.uint64), np.zeros(0), z)
    owners, hashes = [], []
    for at in range(0, len(texts), 500):
        o, h = features(pa.array(texts[at : at + 500], pa.string()))
        order = np.lexsort((h, o))
        o, h = o[order], h[order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
        owners.append(o[new] + at)
        hashes.append(h[new])
    owner, feature_hash = np.concatenate(owners), np.concatenate(hashes)
    kinds, back = np.unique(feature_hash, return_inverse=True)
    toxic = np.bincount(back, labels[owner], minlength=len(kinds))
    clean = np.bincount(back, minlength=len(kinds)) - toxic
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    spread = np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    strength = np.where(toxic + clean >= MIN_DOCUMENTS, np.abs(odds) / spread, 0)
    identity = np.array(sorted({_hash_word(t) for g in groups for t in g}), np.uint64)
    strong = kinds[np.argsort(-strength, kind="stable")[:MAX_FEATURES]]
    strong = strong[np.isin(strong, kinds[strength > 3.0])]
    chosen = np.unique(np.concatenate([strong, identity]))
    model = Model(chosen, np.zeros(len(chosen)), float(np.log(share / (1 - share))))
    row, col = model.found(owner, feature_hash)
    copies, origin = swapped(texts, groups)
    if copies:
        o, h = features(pa.array(copies, pa.string()))
        c_row, c_col = model.found(o, h)
        origin_of = np.array(origin)
        originals = model.found(*features(pa.array([texts[k].lower() for k in origin], pa.string())))
    moment = np.zeros(len(chosen) + 1)
    second = np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        z = model.bias + np.bincount(row, model.weights[col], minlength=len(texts))
        error = (1 / (1 + np.exp(-z)) - labels) / len(texts)
        grad = np.bincount(col, error[row], minlength=len(chosen)) + ridge * model.weights / len(chosen)
        if copies:
            change = np.bincount(originals[0], model.weights[originals[1]], minlength=len(origin_of)) - np.bincount(
                c_row, model.weights[c_col], minlength=len(origin_of)
            )
            pull = 2 * penalty * change / len(origin_of)
            grad += np.bincount(originals[1], pull[originals[0]], minlength=len(chosen))
            grad -= np.bincount(c_col, pull[c_row], minlength=len(chosen))
        full = np.append(grad, error.sum())
        moment = 0.9 * moment + 0.1 * full
        second = 0.999 * second + 0.001 * full**2
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        model.weights -= move[:-1]
        model.bias -= move[-1]
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, where: F.Column, id_column: str, text_column: str, label_column: str,
                    limit: int = MAX_SAMPLE) -> tuple[list[str], np.ndarray]:
    """At most ``limit`` labelled texts, those with the least id hashes; the ids are chosen before any text is read."""
    usable = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & where)
    chosen = usable.select(
        F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"), F.xxhash64(id_column).alias("order")
    ).orderBy("order", "id", "label").limit(limit)
    # At most ``limit`` small rows are broadcast.
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").orderBy("order", "id", "text", "label").limit(limit).select("text", "label").collect()
    return [r.text or "" for r in rows], np.array([r.label for r in rows], float)


def score_toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id and ``score`` from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                text = pc.fill_null(part.column("text"), "")
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(shared.value.scores(text))], [id_column, "score"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"`{id_column}` {ddl_of(docs, id_column)}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: F.Column, id_column: str = "doc_id", text_column: str = "text",
             label_column: str = "toxic", groups: list[list[str]] = IDENTITY_TERMS, limit: int = MAX_SAMPLE) -> DataFrame:
    """Fits on the rows of ``labels`` for which ``learn_from`` holds, then scores all documents."""
    texts, y = labelled_sample(docs, labels, learn_from, id_column, text_column, label_column, limit)
    return score_toxicity(docs, fit(texts, y, groups), id_column, text_column)
