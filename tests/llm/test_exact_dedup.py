from __future__ import annotations

import hashlib
from collections import defaultdict

from emberwatch.llm.exact_dedup import exact_duplicates, fingerprints
from tests.llm.conftest import rows_of

ROWS = [
    (1, "same"), (5, "same"), (3, "same"), (2, ""), (9, None), (4, "other é\n"), (7, "x" * 500), (8, "x" * 500), (6, "x" * 499 + "y"),
    (11, "same "), (12, "Same"), (12, "Same"), (None, "Same"), (None, "nulls"), (None, "nulls"),
]


def expected():
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in sorted(ids, key=str):
            stays = i == keep and not kept
            kept |= stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups(make_docs):
    assert rows_of(exact_duplicates(make_docs(ROWS))) == expected()


def test_chunked_texts_give_the_same_fingerprints(make_docs):
    docs = make_docs(ROWS)
    assert rows_of(fingerprints(docs)) == rows_of(fingerprints(docs, chunk=7))
    assert rows_of(exact_duplicates(docs, chunk=7)) == expected()


def test_colliding_fingerprints_are_split(make_docs):
    assert rows_of(exact_duplicates(make_docs(ROWS), primes=(2, 3))) == expected()


def test_empty(make_docs):
    assert exact_duplicates(make_docs(ROWS).where("doc_id = 1000")).count() == 0
