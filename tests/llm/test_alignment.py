from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from emberwatch.llm import alignment
from emberwatch.llm.alignment import aligned_documents, gallop
from tests.llm.conftest import SF, rows_of

PATHS = tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def brute(rows, libraries):
    """Both tokenizers walked side by side, one token at a time."""
    one, two = libraries
    letters = alignment._byte_letters()

    def bytes_a(i):
        return bytes(letters[c] for c in one.id_to_token(i))

    def bytes_b(i):
        piece = two.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc, text in rows:
        want = (" " + (text or "")).encode()
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
        if not text or b"".join(map(bytes_a, a)) != want or b"".join(map(bytes_b, b)) != want:
            found.append((doc, None))
            continue
        links, groups, ours, theirs = [], [], [], []
        x = y = 0
        end_a, end_b = len(bytes_a(a[0])), len(bytes_b(b[0]))
        ours, theirs = [a[0]], [b[0]]
        while True:
            links.append((a[x], b[y]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a and step_b:
                groups.append(",".join(map(str, ours)) + "|" + ",".join(map(str, theirs)))
                ours, theirs = [], []
            if step_a and x + 1 < len(a):
                x += 1
                end_a += len(bytes_a(a[x]))
                ours.append(a[x])
            elif step_a and step_b:
                break
            if step_b:
                y += 1
                end_b += len(bytes_b(b[y]))
                theirs.append(b[y])
        counts.update(links)
        found.append((doc, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        ((doc, 0, 0, 0, 0, 0, 0, "") if row is None else
         (doc, *row[:3], len(row[3]), sum(counts[link] == best[link[1]] for link in row[3]), sum(counts[link] for link in row[3]), row[4])
         for doc, row in found), key=str,
    )


ODD = ["", None, "a", " ", "  two  spaces", "<|endoftext|> x <s>", "▁", "日本語 text\x00", "\x85a b　c", "tab\tx\n\n  y ", "é" * 30, "﻿bom", "İ ǅ ﬁ", "don't WE'LL 3.14"]


@pytest.mark.parametrize("ranks", [(), RANKS])
def test_equals_a_plain_walk(spark, make_docs, libraries, ranks):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows = texts + [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (7000, texts[0][1])]
    docs = make_docs(rows).withColumnRenamed("id", "keys")
    assert rows_of(aligned_documents(docs, *PATHS, *ranks)) == brute(rows, libraries)


def test_parts_and_shards_change_nothing(make_docs, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "PART_CHARS", 50)
    monkeypatch.setattr(alignment, "FLUSH_PAIRS", 100)
    rows = [(k, "Some words, and more of them: " * (k + 3) + "x" * 200 + " end") for k in range(6)]
    assert rows_of(aligned_documents(make_docs(rows), *PATHS, *RANKS, shard_pairs=7)) == brute(rows, libraries)


def test_empty_table(make_docs):
    assert aligned_documents(make_docs([(1, "a")]).where("false"), *PATHS).count() == 0


def test_rank_file_gives_the_ids_of_the_library(libraries):
    tokens = alignment._tokenizers(*PATHS, *RANKS)
    rng = random.Random(2)
    signs = [chr(c) for c in range(0x250)] + list(" \t\n  ''") * 20 + ["'s", "'ll", "12", "the", " a"]
    texts = [" " + "".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    assert tokens._bytes(texts) == [e.ids for e in libraries[0].encode_batch_fast(texts, add_special_tokens=False)]


def test_gallop_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (5, 0), (1, 1), (500, 3000), (3000, 200)):
        needles, stack = np.unique(rng.integers(0, 4000, n)), np.unique(rng.integers(0, 4000, m))
        assert (gallop(needles, stack) == np.searchsorted(stack, needles)).all()


def test_no_piece_spans_a_cut(libraries):
    """Texts are cut at spaces between visible signs: no token may hold a space behind another sign."""
    pieces = [libraries[1].id_to_piece(i) for i in range(libraries[1].get_piece_size())]
    assert not [p for p in pieces if "▁" in p.lstrip("▁")]
