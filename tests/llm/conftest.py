from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
VOCABULARY = "word_bpe_49k.json"


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with a clashing extra column; rows are (doc_id, text[, lang[, source]])."""

    def make(rows, parts=3):
        full = [(i, t, *(list(rest) + ["en", "src0"][len(rest) :]), None if t is None else len(t), "x") for i, t, *rest in rows]
        ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string"
        return spark.createDataFrame(full, ddl).repartition(parts)

    return make


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    stock = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randint(2, 8))) for _ in range(3000)]

    def some(n, seed):
        r = random.Random(seed)
        return [r.choice(stock) for _ in range(n)]

    return some


@pytest.fixture(scope="session")
def edited(words):
    """A copy of a word list with ``k`` words exchanged."""

    def edit(source, k, seed):
        r = random.Random(seed)
        out = list(source)
        for at in r.sample(range(len(out)), k):
            out[at] = "edit" + str(r.randint(0, 10**9))
        return out

    return edit


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)
