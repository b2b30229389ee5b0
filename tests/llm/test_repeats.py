from __future__ import annotations

import random

import numpy as np
import pytest

from emberwatch.llm import repeats
from emberwatch.llm.repeats import common_prefix_intervals, maximal_repeats, remove_repeats
from tests.llm.conftest import rows_of


def brute(rows):
    """Bytes covered by a 50-byte string that also starts in a document with a smaller id."""
    least = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for k in range(len(b) - 49):
                w = b[k : k + 50]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - 49):
                if least[b[k : k + 50]] < i:
                    gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus(words):
    rng = random.Random(8)
    passages = [" ".join(words(n, 40 + n)) for n in (9, 10, 12, 30, 80)]
    texts = []
    for k in range(70):
        parts = [" ".join(words(rng.randint(1, 40), 1000 + k))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p)), 2))
            parts += [p if rng.random() < 0.5 else p[a:b], " ".join(words(rng.randint(0, 6), 2000 + k))]
        texts.append(rng.choice(["", " ", "é"]).join(parts))
    texts += [texts[3], texts[3][5:], "ab" * 60, "ab" * 90, "x" * 200, "x" * 51, "x" * 50, "x" * 49, "", None, passages[4] * 3, "\0" * 70, "\0" * 60]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [*zip(ids, texts, strict=True), (None, texts[3]), (ids[4], texts[5])]


def test_equals_brute_force(make_docs, corpus):
    got = [(i, n, r, s, bytes(k)) for i, n, r, s, k in remove_repeats(make_docs(corpus)).collect()]
    assert sorted(got, key=str) == brute(corpus)


def test_hot_anchors(make_docs, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_LEAST", 3)
    monkeypatch.setattr(repeats, "HOT_SHARE", 0.0)
    got = [(i, n, r, s, bytes(k)) for i, n, r, s, k in remove_repeats(make_docs(corpus)).collect()]
    assert sorted(got, key=str) == brute(corpus)


def test_short_and_empty(make_docs):
    rows = [(1, "short"), (2, None), (3, "")]
    assert rows_of(remove_repeats(make_docs(rows)).drop("kept")) == [(1, 5, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0)]
    assert remove_repeats(make_docs(rows).where("doc_id = 9")).count() == 0


def test_intervals():
    rng = random.Random(1)
    for _ in range(100):
        lcp = [0] + [rng.randint(0, 5) for _ in range(rng.randint(1, 20))]
        want = set()
        for a in range(len(lcp)):
            for b in range(a + 1, len(lcp)):
                low = min(lcp[a + 1 : b + 1])
                if low >= 2 and lcp[a] < low and (b + 1 == len(lcp) or lcp[b + 1] < low):
                    want.add((low, a, b))
        assert set(common_prefix_intervals(lcp, 2)) == want


def test_maximal_repeats_with_all_occurrences():
    rng = random.Random(6)
    for _ in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))).encode() for _ in range(4)]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0] + [len(t) for t in texts])
        places = {}
        for t, base in zip(texts, offsets, strict=False):
            for n in range(4, len(t) + 1):
                for k in range(len(t) - n + 1):
                    left = t[k - 1 : k] if k else base
                    right = t[k + n : k + n + 1] if k + n < len(t) else base
                    places.setdefault(t[k : k + n], []).append((int(base) + k, left, right))
        want = set()
        for s, at in places.items():
            lefts, rights = [x[1] for x in at], [x[2] for x in at]
            many = lambda side: len(set(side)) > 1 or any(isinstance(x, (int, np.integer)) for x in side)
            if len(at) > 1 and many(lefts) and many(rights):
                want.add((len(s), tuple(sorted(x[0] for x in at))))
        got = {(n, tuple(sorted(s.tolist()))) for n, s in maximal_repeats(raw, offsets, 4)}
        assert got == want
