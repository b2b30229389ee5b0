from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import language_id as L
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def labelled():
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF.replace('0.001', '0.01')}/documents.parquet'").fetchall()
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    return [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2], L.fit([r[1] for r in learn], [r[2] for r in learn])


def test_held_out_accuracy(spark, labelled):
    held_out, model = labelled
    docs = spark.createDataFrame(held_out, "doc_id bigint, text string, lang string")
    out = {r.doc_id: r for r in L.label_texts(docs, model).collect()}
    right = sum(out[i].lang_pred == lang for i, _, lang in held_out)
    assert right >= 0.97 * len(held_out)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_code_switched_text(make_docs, labelled):
    held_out, model = labelled
    pick = {lang: next(" ".join(t.split()[:60]) for _, t, x in held_out if x == lang and len(t.split()) > 80 and "|" not in t and "#" not in t) for lang in ("en", "fr", "de")}
    text = " ".join(pick.values())
    row = L.label_texts(make_docs([(1, text)]), model, spans=True).first()
    at = {k: s.lang for s in row.spans for k in range(s.first_word, s.stop_word)}
    n = row.n_words
    for third, lang in enumerate(pick):
        inside = [at[k] for k in range(n * third // 3 + 5, n * (third + 1) // 3 - 5)]
        assert inside.count(lang) >= 0.8 * len(inside)
    assert row.spans[0].first_word == 0 and row.spans[-1].stop_word == n and row.n_switches == len(row.spans) - 1


def test_edges(make_docs, labelled):
    _, model = labelled
    rows = [(1, None), (2, ""), (3, "123 !?"), (3, "the of and"), (3, "the of and"), (None, "x"), (4, "the " * 30000)]
    out = L.label_texts(make_docs(rows), model).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.lang_pred == "und" and r.score == 0) == (r.doc_id in (1, 2) or r.n_words == 0)
    docs = make_docs(rows)
    known = L.known_language(docs, model)
    assert known.columns == docs.columns and known.count() == 4 and known.where("doc_id = 3").count() == 2
    nothing = L.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    one = L.identify(docs, F.lit(True)).where("n_words > 0").collect()
    assert {r.lang_pred for r in one} == {"en"}
    assert L.label_texts(docs.where("doc_id = 99"), model).count() == 0


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    t = rng.normal(size=(3, 3)).astype(np.float32)
    sizes = np.array([1, 64, 65, 200, 2])
    scores = rng.normal(size=(sizes.sum(), 3)).astype(np.float32)
    got, at = L.marginals(scores, sizes, t), 0
    for n in sizes:
        e, a = np.exp(scores[at : at + n].astype(float)), np.exp(t.astype(float))
        forward = [np.ones(3) @ a * e[0]]
        for k in range(1, n):
            v = forward[-1] @ a * e[k]
            forward.append(v / v.sum())
        backward = [np.ones(3)]
        for k in range(n - 1, 0, -1):
            v = a @ (e[k] * backward[-1])
            backward.append(v / v.sum())
        want = np.array(forward) * np.array(backward[::-1])
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True), atol=1e-5)
        at += n


def test_words_and_features():
    w = L.words_of(pa.array(["Ab c", "", None, "é1f"]))
    assert w.text_of.tolist() == [0, 0, 3, 3]
    assert np.diff(np.append(w.bigram_starts, len(w.bigram_slots))).tolist() == [3, 2, 3, 2]


def test_every_label_has_its_share_of_the_sample(make_docs, words, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_BYTES", 40_000)
    rare = [(10_000 + k, f"selten{k} " * 30, "de") for k in range(5)]
    rows = [(k, "the long one é " * 20_000, "en") for k in range(300)] + rare + [(20_000, "é" * 50_000, "fr"), (20_001, "petit", "fr")]
    rows += [(7, f"mismo {k}", "es") for k in range(1000)]  # one id: all or none below a bound
    texts, labels = L.labelled_sample(make_docs(rows), F.lit(True), "doc_id", "text", "lang", per_label=20)
    by_label = {name: [t for t, x in zip(texts, labels, strict=True) if x == name] for name in set(labels)}
    assert {name: len(t) for name, t in by_label.items()} == {"en": 20, "de": 5, "fr": 2, "es": 20}
    assert sorted(by_label["de"]) == sorted(t for _, t, _ in rare)
    assert all(sum(len(t.encode()) for t in g) <= 10_000 for g in by_label.values())
    assert all(450 <= len(t.encode()) <= 500 for t in by_label["en"]) and len(set(by_label["en"])) > 1
    assert "petit" in by_label["fr"] and max(len(t.encode()) for t in by_label["fr"]) > 9_900
    again = L.labelled_sample(make_docs(rows, parts=5), F.lit(True), "doc_id", "text", "lang", per_label=20)
    assert again == (texts, labels)


def test_common_length():
    assert L.common_length([5, 1, 9], 100) == 9 and L.common_length([5, 1, 9], 11) == 5 and L.common_length([5, 1, 9], 10) == 4
    assert L.common_length([0], 10) == 1 and L.common_length([10**9], 10) == 10


def test_label_with_short_texts_only_is_learned():
    model = L.fit(["the of and to in is " * 20] * 5 + ["der die das und ist"] * 5, ["en"] * 5 + ["de"] * 5)
    assert L._predict(model, pa.array(["das ist der die", "the of and to"]))[0].to_pylist() == ["de", "en"]


LETTERLESS = ["— 12 —", "€ 100", "🙂", "\u00a0", "٣٤٥", "12 « »", "1 ½ ²", "\u0301"]


def test_texts_without_a_letter(make_docs, labelled):
    _, model = labelled
    rows = [(k, t) for k, t in enumerate(LETTERLESS)] + [(100, "日本"), (101, "é"), (102, "— я —"), (103, "1ª"), (104, None)]
    docs = make_docs(rows)
    out = {r.doc_id: (r.lang_pred == "und", r.score == 0, r.n_words == 0, r.n_switches, r.spans == []) for r in L.label_texts(docs, model, spans=True).collect()}
    assert {i for i, r in out.items() if r == (True, True, True, 0, True)} == {*range(len(LETTERLESS)), 104}
    assert {i for i, r in out.items() if r[:3] == (False, False, False)} == {100, 101, 102, 103}
    assert {r.doc_id for r in L.known_language(docs, model, least=0).collect()} == {100, 101, 102, 103}


def test_known_language_uses_the_verdict(make_docs, labelled):
    held_out, model = labelled
    clean = [(k, t) for k, (_, t, _) in enumerate(held_out) if any(c.isalpha() for c in t)]
    docs = make_docs([*clean, (-1, "the of le la der die el los " * 9), (-2, "12"), (-3, None)])
    assert sorted(r.doc_id for r in L.known_language(docs, model).collect()) == [k for k, _ in clean]
    for untaught in (L.fit([], []), L.fit(["a", "b", "c", "d"], ["de", "en", "es", "fr"])):
        assert sorted(r.doc_id for r in L.known_language(docs, untaught).collect()) == [-1, *[k for k, _ in clean]]


def test_gradient_of_the_likelihood():
    """Gradients by scores and by transitions against finite differences of the log-likelihood of a labelled chain."""
    from emberwatch.llm.language_id import forward_backward, pair_marginals

    rng = np.random.default_rng(3)
    sizes, k = np.array([70, 12]), 3
    scores, transitions = rng.normal(size=(82, k)), rng.normal(size=(k, k))
    gold = rng.integers(0, k, 82)
    inner = np.array([x for x in range(81) if x != 69])

    def likelihood(scores, transitions):
        total, at = 0.0, 0
        for n in sizes:
            forward = scores[at].copy()
            for x in range(at + 1, at + n):
                forward = scores[x] + np.logaddexp.reduce(forward[:, None] + transitions, axis=0)
            total -= np.logaddexp.reduce(forward)
            at += n
        return total + scores[np.arange(82), gold].sum() + transitions[gold[inner], gold[inner + 1]].sum()

    # The operator gives a text's first word a uniform label before it; its transition is taken out for the plain chain.
    prob, past = forward_backward(scores, sizes, transitions)
    heads = np.array([0, 70])
    even = scores.copy()
    even[heads] += np.log(np.exp(transitions).mean(axis=0))
    expected = pair_marginals(prob, past, transitions, inner)
    observed = np.bincount(gold[inner] * k + gold[inner + 1], minlength=k * k).reshape(k, k)
    eps = 1e-5
    for a in range(k):
        for b in range(k):
            step = np.zeros((k, k))
            step[a, b] = eps
            slope = (likelihood(even, transitions + step) - likelihood(even, transitions - step)) / (2 * eps)
            assert abs(slope - (observed - expected)[a, b]) < 2e-2
    for x in (0, 5, 69, 70, 81):
        for c in range(k):
            step = np.zeros((82, k))
            step[x, c] = eps
            slope = (likelihood(even + step, transitions) - likelihood(even - step, transitions)) / (2 * eps)
            assert abs(slope - ((gold[x] == c) - prob[x, c])) < 1e-3
    assert np.allclose(pair_marginals(prob, past, transitions, inner).sum(axis=0), prob[inner + 1].sum(axis=0), atol=1e-3)
