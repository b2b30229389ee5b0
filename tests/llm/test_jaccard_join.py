from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from emberwatch.llm import jaccard_join
from emberwatch.llm.components import components
from emberwatch.llm.jaccard_join import divide_skip, similar_components
from emberwatch.llm.texts import pack
from tests.llm.conftest import rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] * bool(w))

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return sorted(((i, len(sets[k]), min(least[find(k)], default=None)) for k, (i, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def corpus(words, edited):
    rows = []
    passage = words(60, 900)
    for g in range(12):
        base = words(40 + 15 * g, g)
        rows += [base] + [edited(base, k, 100 * g + k) for k in range(0, 9)]
    hub = words(120, 500)
    rows += [edited(hub, k % 6, 7000 + k) for k in range(90)]  # one large group of near copies
    rows += [passage + words(10 + k % 9, 300 + k) for k in range(40)]  # a shared passage
    chain = words(80, 77)
    for k in range(12):  # each like the one before, the ends unlike each other
        chain = edited(chain, 1, 50 + k)
        rows.append(chain)
    texts = [" ".join(w) for w in rows]
    texts += [None, "", "  \n", "one", "ONE", "one two three", "One two\nthree", "a b c d e", "A b  c\td e", "a b c d e f", texts[0], texts[0].upper()]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    return [(order[k], t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("cell", [400, 25])
def test_equals_brute_force(make_docs, corpus, monkeypatch, cell):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    assert rows_of(similar_components(make_docs(corpus)).drop("text_key")) == brute(corpus)


def test_hot_lists_are_dealt_out(make_docs, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_LIST", 5)
    assert rows_of(similar_components(make_docs(corpus)).drop("text_key")) == brute(corpus)


def test_null_and_empty(make_docs, words):
    text = " ".join(words(30, 1))
    rows = [(None, text), (None, None), (3, text), (4, None)]
    assert rows_of(similar_components(make_docs(rows)).drop("text_key")) == brute(rows)[:0] + sorted(
        [(None, 26, 3), (3, 26, 3), (None, 0, None), (4, 0, 4)], key=str
    )
    assert similar_components(make_docs(rows).where("doc_id = 99")).count() == 0


def test_divide_skip():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 25)
        lists = [sorted(rng.sample(range(40), rng.randint(0, 25))) for _ in range(n)]
        least = rng.randint(1, n)
        counts = defaultdict(int)
        for x in lists:
            for i in x:
                counts[i] += 1
        assert divide_skip(lists, least) == {i: c for i, c in counts.items() if c >= least}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(200 + k, 201 + k) for k in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    loops = {x for a, b in edges if a == b for x in (a,)} - {x for a, b in edges if a != b for x in (a, b)}
    want = {x: find(x) for x in parent if x not in loops}
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_unlinked_members_of_a_list_take_few_seats(spark, monkeypatch):
    """2,000 classes on one list, four of them linked: rows grow with members times parts, no pair is listed."""
    rng = random.Random(8)
    members = [sorted(rng.sample(range(1 << 40), 40)) for _ in range(2_000)]
    members[1500] = sorted(members[3][:38] + [1, 2])
    members[700] = sorted(members[1500][:38] + [3, 4])
    members[41] = sorted(members[40][:39] + [5])
    packed = [np.array(x, np.uint64) for x in members]
    sets = spark.createDataFrame(
        [(k, 40, pack(x[:10], jaccard_join.SET_BYTES), pack(x[10:], jaccard_join.SET_BYTES)) for k, x in enumerate(packed)],
        "node bigint, size bigint, short binary, long binary",
    )
    lists = spark.createDataFrame([(s, k, 40, k) for s in (11, 12) for k in range(2_000)], "shingle bigint, node bigint, size bigint, root bigint")
    seen = {}
    real = jaccard_join.materialize

    def counted(df, name):
        out = real(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    found = {frozenset((r.a, r.b)) for r in jaccard_join.list_links(lists, sets).collect()}
    assert found == {frozenset((3, 1500)), frozenset((700, 1500)), frozenset((40, 41))} or components_of(found) == [{3, 700, 1500}, {40, 41}]
    assert seen["seats"] <= 2_000 * 6 and seen["sub-lists"] <= 8_000


def components_of(pairs):
    out = []
    for pair in pairs:
        joined = [c for c in out if c & pair]
        out = [c for c in out if not c & pair] + [set(pair).union(*joined)]
    return sorted(out, key=min)
