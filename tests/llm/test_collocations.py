from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from emberwatch.llm import collocations as c
from tests.llm.conftest import rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for n in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if n >= least and len(p) > 1}
        scored = []
        for p, a in found.items():
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * n >= 50 * a for q, n in found.items()):
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], start=1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    stock = [f"w{k}" for k in range(40)] + ["Étude", "ÉTUDE", "naïve", "x y"]
    rows = []
    for k in range(150):
        text = ""
        for _ in range(rng.randint(1, 60)):
            text += rng.choice(["New York city", "new york", rng.choice(stock), rng.choice(stock), "aa aa aa"]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ! "])
        rows.append((rng.choice(["en", "en", "de", None]), text))
    return [*rows, ("en", None), ("en", ""), ("fr", " .,; \n"), ("fr", "only one"), (None, "a")]


def frame(make_docs, rows):
    return make_docs([(k, text, lang) for k, (lang, text) in enumerate(rows)])


@pytest.mark.parametrize("shard", [c.SHARD_PHRASES, 60])
def test_equals_brute_force(make_docs, corpus, shard):
    got = rows_of(c.collocations(frame(make_docs, corpus).withColumnRenamed("id", "key"), shard_phrases=shard))
    assert got == brute(corpus) and len(got) > 30


def test_top_and_ties(make_docs):
    rows = [("en", "b a. d c. f e\n" * 10)]
    assert [r[1:3] for r in rows_of(c.collocations(frame(make_docs, rows), top=2))] == [(1, "b a"), (2, "d c")]


def test_long_text_is_cut_at_piece_ends(make_docs, monkeypatch):
    monkeypatch.setattr(c, "SLICE", 300)
    rows = [("en", "one two three, four five; " * 400), ("de", "no end " * 300), ("en", "x")]
    assert rows_of(c.collocations(frame(make_docs, rows))) == brute(rows)


def test_empty_tables(make_docs, corpus):
    assert c.collocations(frame(make_docs, corpus).where("false")).count() == 0
    assert c.collocations(frame(make_docs, corpus[-5:])).count() == 0


def test_scores_past_64_bits(make_docs, spark, monkeypatch):
    """Counts of a billion: their products do not fit 64 bits."""
    real = c.phrase_counts

    def many(texts, *args):
        phrases, langs = real(texts, *args)
        return phrases.withColumn("f", phrases.f * 10**9), langs

    rows = [("en", "p q. " * 12 + "p r. q s.")]
    monkeypatch.setattr(c, "phrase_counts", many)
    [(_, _, phrase, a, left, right, n, score)] = rows_of(c.collocations(frame(make_docs, rows)))
    assert (phrase, a, left, right, n, score) == ("p q", 12 * 10**9, 13 * 10**9, 13 * 10**9, 28, 10**6 * 144 // 169)


def test_trie_accepts_its_phrases_only():
    rng = np.random.default_rng(5)
    words = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    phrases = [words[:, None], *[np.unique(words[rng.integers(0, 300, (2000, n))], axis=0) for n in (2, 3)]]
    trie, states = c.Trie.build(phrases)
    known = {tuple(p): s for group, found in zip(phrases, states, strict=True) for p, s in zip(group.tolist(), found.tolist(), strict=True)}
    assert len(set(known.values())) == len(known)
    begins = {p[:2] for p in known if len(p) == 3}
    for p in [*list(known)[::7], *[tuple(x) for x in words[rng.integers(0, 300, (500, 3))].tolist()]]:
        state = np.zeros(1, np.int64)
        for w in p:
            state = trie.advance(state, trie.numbers(np.array([w], np.uint64)))
        assert state[0] == known.get(p, state[0] if p in begins else -1)


def test_a_trie_takes_four_bytes_a_number():
    """Its arrays are held by every task and sent as bytes: eight bytes each took an executor beyond its memory."""
    words = np.random.default_rng(3).integers(1, 1 << 63, 500, dtype=np.uint64)
    trie, _ = c.Trie.build([words[:, None], np.stack([words[:-1], words[1:]], axis=1)])
    assert trie.base.itemsize == trie.check.itemsize == 4


def test_text_passes_follow_from_what_is_returned(make_docs, corpus, monkeypatch):
    """One pass per shard of candidates made the work grow faster than the texts."""
    docs = frame(make_docs, corpus)
    real, passes = type(docs).mapInArrow, []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *args: passes.append(schema) or real(self, f, schema, *args))
    assert rows_of(c.collocations(docs, top=3, shard_phrases=60)) == brute(corpus, top=3)
    assert len(passes) == 5


def test_ties_at_the_last_rank_are_ordered_by_phrase(make_docs):
    pairs = [f"{a}{b} {b}{a}" for a in "zyxw" for b in "abcd"]
    rows = [("en", ". ".join(pairs) + "\n")] * 12
    got = rows_of(c.collocations(frame(make_docs, rows), top=5, shard_phrases=4))
    assert got == brute(rows, top=5) and len(got) == 5


def test_packed_counts_merge_to_exact_counts(monkeypatch):
    """Counts of several flushes of two languages, summed up by part."""
    monkeypatch.setattr(c, "MOST_HELD", 40)
    rng = np.random.default_rng(7)
    pool, true, rows = rng.integers(1, 1 << 63, 12, dtype=np.uint64), Counter(), []
    held = c._Counts(2, 3)
    for _ in range(20):
        at = rng.integers(0, 12, (30, 2))
        true.update(map(tuple, pool[at].tolist()))
        held.add((at[:, 0] % 2), None, [pool[at[:, 0]], pool[at[:, 1]]])
        if held.merged > c.MOST_HELD // 2:
            rows += held.packed(["de", "en"])
    table = pa.Table.from_batches([*rows, *held.packed(["de", "en"])])
    got = {}
    for part in range(3):
        of_part = table.filter(pa.compute.equal(table.column("part"), part))
        for row in c._count_part(3)(of_part).to_pylist() if len(of_part) else []:
            got[(row["h1"], row["h2"])] = (row["f"], row["lang"])
    number = {h: k for k, h in enumerate(pool.tolist())}
    assert len(rows) > 1 and got == {p: (n, ("de", "en")[number[p[0]] % 2]) for p, n in true.items() if n >= 3}
