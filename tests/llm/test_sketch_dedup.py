from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from emberwatch.llm import sketch_dedup
from emberwatch.llm.sketch_dedup import PERCENT, estimate, merge_sketches, may_be_similar, similar_documents, sketches
from tests.llm.conftest import rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] * bool(w))

    sets, parent, lists = [shingles(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, shared in Counter(j for s in a for j in lists[s]).items():
            if 100 * shared >= 85 * (len(a) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
        for s in a:
            lists[s].append(i)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        component = min(least[find(k)], default=None) if sets[k] else i
        out.append((i, len(sets[k]), component, i == component))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus(words, edited):
    texts = []
    for g in range(8):
        base = words(30 + 20 * g, g)
        texts += [base, *[edited(base, k, 10 * g + k) for k in range(5)]]
    hub = words(150, 99)
    texts += [edited(hub, k % 4, 500 + k) for k in range(120)]  # one large group of near copies
    chain = words(90, 77)
    for k in range(10):  # each like the one before
        chain = edited(chain, 1, 50 + k)
        texts.append(chain)
    made = [" ".join(t) for t in texts]
    made += [None, "", " \t\n", "one", "ONE", "one two", "one two three", "One\ttwo\nthree", made[0], made[0].upper()]
    return [(k * 7 % len(made), t) for k, t in enumerate(made)] if len(made) % 7 else list(enumerate(made))


def test_equals_brute_force(make_docs, corpus):
    assert rows_of(similar_documents(make_docs(corpus))) == brute(corpus)


def test_small_cells_and_late_rounds_change_nothing(make_docs, corpus, monkeypatch):
    monkeypatch.setattr(sketch_dedup, "CELL_SHINGLES", 300)
    monkeypatch.setattr(sketch_dedup, "PART", 7)
    monkeypatch.setattr(sketch_dedup, "LEADERS", (1,))
    few = corpus[:60] + corpus[-12:]
    assert rows_of(similar_documents(make_docs(few))) == brute(few)


def test_edges(make_docs, words):
    text = " ".join(words(40, 1))
    rows = [(None, text), (None, None), (3, text), (3, text), (4, ""), (5, "x " * 300_000)]
    assert rows_of(similar_documents(make_docs(rows).withColumnRenamed("id", "node"))) == sorted(
        [(None, 38, 3, False), (3, 38, 3, True), (3, 38, 3, True), (None, 0, None, True), (4, 0, 4, True), (5, 1, 5, True)], key=str
    )
    assert similar_documents(make_docs(rows).where("false")).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    shared, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 60, 40))
    a, b = np.sort(np.concatenate([shared, one])), np.sort(np.concatenate([shared, two]))
    both = np.unique(np.concatenate([a, b]))
    s = [sketches(x, np.array([0, len(x)]))[0] for x in (a, b, both)]
    assert (merge_sketches(s[0], s[1]) == s[2]).all()
    above, below = np.array([(s[0] > s[1]).sum()]), np.array([(s[0] < s[1]).sum()])
    found = estimate(float(len(a)), np.array([len(b)], float), above, below, sketch_dedup.REGISTERS - above - below)[0]
    assert abs(found - 600 / 700) < 0.12
    unlike = sketches(two, np.array([0, 40]))
    assert may_be_similar(np.array([len(a)]), np.array([len(b)]), s[0][None], s[1][None]).all()
    assert not may_be_similar(np.array([40]), np.array([60]), unlike, sketches(one, np.array([0, 60]))).any()


def test_truncated_minima_are_locality_sensitive():
    """Registers of sets of similarity J agree about as often as J says."""
    rng = np.random.default_rng(9)
    agree = []
    for _ in range(40):
        x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = sketches(x[:190], np.array([0, 190])), sketches(x[10:], np.array([0, 190]))
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 180 / 200) < 0.02 and PERCENT == 85


def test_a_large_component_is_seated_once_beside_few_others(spark, monkeypatch):
    """One class outside a component of 99: before, every two parts of the bucket were a cell, 1,500 seats."""
    monkeypatch.setattr(sketch_dedup, "PART", 7)
    seats, materialize = [], sketch_dedup.materialize

    def counted(df, name):
        out = materialize(df, name)
        seats.extend([out.count()] if name == "part-seats" else [])
        return out

    monkeypatch.setattr(sketch_dedup, "materialize", counted)
    one, other = (np.arange(20, dtype=np.uint64) + np.uint64(k) for k in (0, 100))
    sets = [(k, 20, bytearray((one if k in (50, 99) else other).tobytes())) for k in range(100)]
    left = spark.createDataFrame([(1, k, 20, 0 if k < 99 else 99, k < 99) for k in range(100)], "key long, node long, size long, root long, inside boolean")
    links = sketch_dedup.part_links(left, spark.createDataFrame(sets, "node long, size long, data binary")).collect()
    assert {tuple(sorted(x)) for x in links} == {(50, 99)}
    assert seats == [99 + 15]


def test_one_leader_a_bucket_and_all_links(make_docs, words, edited, monkeypatch):
    """Many near copies: every bucket lists a pair for each member with one leader, not with four more in a second round."""
    pairs, materialize = [], sketch_dedup.materialize

    def counted(df, name):
        out = materialize(df, name)
        if name in ("pairs", "buckets"):
            pairs.append((name, out.count()))
        return out

    monkeypatch.setattr(sketch_dedup, "materialize", counted)
    hub = words(150, 99)
    rows = [(k, " ".join(edited(hub, k % 6, 700 + k))) for k in range(150)]
    assert rows_of(similar_documents(make_docs(rows))) == brute(rows)
    assert [name for name, _ in pairs] == ["buckets", "pairs"] and pairs[1][1] < pairs[0][1]
