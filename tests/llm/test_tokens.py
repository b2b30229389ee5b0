"""BPE codec and token counts against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from emberwatch.llm import bpe_codec, token_counts, wordbpe
from tests.llm.conftest import rows_of

TRICKY = [
    None, "", " ", "\n\t", "don't DON'T 's 'S we'll", "Straße İstanbul ΣΑΣ 日本語 ǅ ﬁ ª²½", "x<|endoftext|>y <|startoftext|>", "<|endof", "a" * 700,
    "ab" * 900, "é́ é ́x", "1234 5,6.7", "\x1c\x1fq\x85r\xa0s t​u", "🙂🙂 ok", "don’t ... !!??", " xy", "a" * 100 + "'s",
]


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


def encode(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library, vocabulary):
    bpe = wordbpe.WordBpe(vocabulary)
    rng = random.Random(3)
    alphabet = "abcdeéßñ '’<|>.!0123 \n" + "ABZ"
    texts = [t for t in TRICKY if t] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        want = encode(library, text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:40]
        assert bpe.decode(ids) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["Ⱥbc", "xȾy", "ȺȾ é 1Ⱥ", "Ⱥ" * 40, *[f"a{chr(c)}b C" for c in (0x130, 0x149, 0x1F0, 0x1C5, 0x243, 0x244, 0x245)]])
def test_letters_with_lower_case_far_beyond(library, vocabulary, text):
    assert np.frombuffer(wordbpe.WordBpe(vocabulary).encode([text])[0], "<u4").tolist() == encode(library, text)


def test_all_latin_letters(library, vocabulary):
    bpe = wordbpe.WordBpe(vocabulary)
    texts = [f"b{chr(c)}b" for c in range(1, wordbpe.LATIN)]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in bpe.encode(texts)]
    assert [t for t, ids in zip(texts, got, strict=True) if ids != encode(library, t)] == []


def test_both_merges_agree(vocabulary):
    bpe = wordbpe.WordBpe(vocabulary)
    rng = random.Random(4)
    for _ in range(60):
        word = "".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(2, 60)))
        base = bpe.base(bpe.symbols(word))
        slow = list(base)
        while True:
            ranked = [(bpe.merges[p], i) for i in range(len(slow) - 1) if (p := (slow[i], slow[i + 1])) in bpe.merges]
            if not ranked:
                break
            (_, new), at = min(ranked, key=lambda x: (x[0][0], x[1]))
            slow[at : at + 2] = [new]
        assert bpe.merge(list(base)) == slow


def test_codec_rows(make_docs, library, vocabulary):
    rows = [(k, t) for k, t in enumerate(TRICKY)] + [(3, TRICKY[4]), (3, TRICKY[4]), (None, "null id")]
    out = bpe_codec.token_digests(bpe_codec.encode_decode(make_docs(rows), vocabulary))
    want = []
    for i, t in rows:
        ids = encode(library, t)
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert rows_of(out) == sorted(want, key=str)
    assert bpe_codec.encode_decode(make_docs([(1, "x")]).where("doc_id = 2"), vocabulary).count() == 0


def test_counts_and_splices(make_docs, library, vocabulary, words):
    rows = [(k, t) for k, t in enumerate(TRICKY)]
    rows += [(100, " ".join(words(400, 1))), (101, "w" * 900 + " " + " ".join(words(60, 2))), (101, "x" * 2000), (None, " ".join(words(300, 3)) + "<|endoftext|>" * 9)]
    rows += [(102, " ".join(words(50, 4)) + " " * 300 + "z" * 300)]
    want = sorted(((i, len((t or "").encode()), len(encode(library, t))) for i, t in rows), key=str)
    for chunk, overlap in ((200, 20), (150, 60), (65536, 512)):
        out = token_counts.count_tokens(make_docs(rows), vocabulary, chunk=chunk, overlap=overlap)
        assert rows_of(out) == want, (chunk, overlap)
    assert token_counts.count_tokens(make_docs([(1, "x")]).where("doc_id = 2"), vocabulary).count() == 0
