from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from emberwatch.llm import mixing
from tests.llm.conftest import rows_of


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def brute(rows, repeats=None, entropy=None, ratio=1.0):
    """Copies of every row by plain loops."""
    n_tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]
    source = ["-" if s is None else "=" + s for *_, s in rows]
    key = ["" if i is None else str(i) for i, *_ in rows]
    tokens = Counter()
    for s, n in zip(source, n_tokens, strict=True):
        tokens[s] += n
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items() if n}

    def weights(a):
        z = sum(v**a for v in p.values())
        return {s: v**a / z for s, v in p.items()}

    def meets(a):
        w = weights(a)
        if entropy is not None:
            return -sum(x * math.log(x) for x in w.values()) <= entropy
        return max(ratio * w[s] / p[s] for s in w) <= repeats

    low, high = 0.0, 1.0
    for _ in range(30):
        mid = (low + high) / 2
        low, high = (low, mid) if meets(mid) else (mid, high)
    w = weights(high)
    copies = [0] * len(rows)
    for s in p:
        share = math.floor(round(w[s] * int(ratio * total), 3))
        passes, rest = divmod(share, tokens[s])
        mine = [k for k in range(len(rows)) if source[k] == s]
        n_blocks = math.ceil(math.sqrt(len(mine)))
        blocks = defaultdict(list)
        for k in mine:
            blocks[int(md5(key[k])[:8], 16) % n_blocks].append(k)
            copies[k] = passes
        upto = 0
        for b in sorted(blocks, key=lambda b: (md5(f"{s}/{b}/{passes}"), b)):
            size = sum(n_tokens[k] for k in blocks[b])
            if upto + size <= rest:
                for k in blocks[b]:
                    copies[k] += 1
                upto += size
                continue
            groups = defaultdict(list)
            for k in blocks[b]:
                groups[md5(f"{key[k]}/{passes}"), key[k]].append(k)
            for g in sorted(groups):
                upto += sum(n_tokens[k] for k in groups[g])
                if upto <= rest:
                    for k in groups[g]:
                        copies[k] += 1
            break
    return sorted(((i, s, n, c) for (i, _, _, s), n, c in zip(rows, n_tokens, copies, strict=True)), key=str), high


@pytest.fixture(scope="module")
def corpus(words):
    rows = [(k, " ".join(words(1 + k % 37, k)), "en", ("big", "big", "mid", "s1", "s2")[k % 5] if k % 7 else None) for k in range(300)]
    return rows + [(7, "one two", "en", "s1"), (7, "one two", "en", "s1"), (None, "x y z", "en", "mid"), (None, None, "en", "mid"), (500, "", "en", "bare"), (501, None, "en", "bare")]


@pytest.mark.parametrize("options", [{"repeats": 1.2}, {"repeats": 3.0}, {"repeats": None, "entropy": 1.5}, {"repeats": 2.5, "budget_ratio": 2.0}, {"repeats": 0.4, "budget_ratio": 0.3}])
def test_equals_brute_force(make_docs, corpus, options):
    want, _ = brute(corpus, options.get("repeats"), options.get("entropy"), options.get("budget_ratio", 1.0))
    docs = make_docs(corpus)
    assert rows_of(mixing.decide(docs, **options).select("doc_id", "source", "n_tokens", "copies")) == want


def test_realised_rows(make_docs, corpus):
    docs = make_docs(corpus)
    out = mixing.realise(docs, repeats=1.2)
    assert out.columns == docs.columns
    copies = Counter()
    for i, _, _, c in brute(corpus, 1.2)[0]:
        copies[i] += c
    assert Counter(r.doc_id for r in out.collect()) == +copies


def test_limits_hold(make_docs, corpus):
    mix, _ = mixing.plan(make_docs(corpus), repeats=1.2)
    tokens = {r.source_key: (r.weight, r.tokens) for r in mix.sources.collect()}
    total = sum(t for _, t in tokens.values())
    assert max(w * total / t for w, t in tokens.values() if t) <= 1.2 + 1e-6
    assert abs(sum(w for w, _ in tokens.values()) - 1) < 1e-9
    assert 0 < mix.exponent < 1


def test_empty(make_docs, corpus):
    docs = make_docs(corpus)
    assert mixing.decide(docs.where("doc_id = 10000")).count() == 0
    assert rows_of(mixing.decide(docs.where("source = 'bare'")).select("doc_id", "copies")) == [(500, 0), (501, 0)]
