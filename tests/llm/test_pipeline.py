"""Every stage of the pipeline against plain loops, and the whole on a small table."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from emberwatch.llm import language_id
from tests.llm.conftest import SF
from tests.llm.test_jaccard_join import brute as similar
from tests.llm.test_mixing import brute as mixed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(make_docs, words, edited):
    rows = []
    for k in range(40):
        w = words(30 + k, k)
        rows += [(10 * k, " ".join(w), "en", f"s{k % 3}"), (10 * k + 1, " ".join(w), None, f"s{k % 2}"), (10 * k + 2, " ".join(edited(w, 1, k)), "fr", None)]
    rows += [(1000, "12 34", "en", "s0"), (1001, None, None, None), (1002, "", "en", "s1"), (None, " ".join(words(30, 0)), "en", "s1"), (0, rows[0][1], "en", "s0"), (0, rows[0][1], "en", "s0")]
    return make_docs(rows).drop("id")


def listed(df):
    return Counter(map(tuple, df.select(COLUMNS).collect()))


def test_language_stage(spark, docs):
    out = P.language(spark, docs, None)
    assert out.columns == COLUMNS
    assert listed(out) == Counter({r: n for r, n in listed(docs).items() if r[1] and any(c.isalpha() for c in r[1])})


def test_language_stage_without_labels(spark, docs):
    out = P.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), None)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))


def test_exact_stage(spark, docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r)
    out = P.exact(spark, docs, None).collect()
    assert len(out) == len(groups)
    for r in out:
        ids = [x.doc_id for x in groups.pop(r.text or "") if x.doc_id is not None]
        assert r.doc_id == max(ids, default=None)
    assert not groups


def test_near_stage(spark, docs):
    once = P.exact(spark, docs, None)
    rows = [(r.doc_id, r.text) for r in once.collect()]
    keep = Counter((i, c) for i, _, c in similar(rows) if i == c)
    out = P.near(spark, once, None)
    assert Counter((r.doc_id, r.doc_id) for r in out.collect()) == keep
    assert set(listed(out)) <= set(listed(once))


def test_near_stage_keeps_one_row_of_each_component(spark, make_docs, words, edited):
    a, b, c, d, e = (words(40, 70 + k) for k in range(5))
    copy = [" ".join(edited(w, 1, 9)) for w in (a, b, c, d, e)]
    rows = [(1, " ".join(a)), (1, copy[0]), (1, copy[0])]  # the least id with different and equal texts
    rows += [(1, " ".join(b)), (2, copy[1])]  # the same least id in another component
    rows += [(None, " ".join(c)), (None, copy[2]), (None, " ".join(c))]  # no id at all
    rows += [(None, " ".join(d)), (9, copy[3])]
    rows += [(5, " ".join(e))] * 3  # equal rows
    rows += [(6, ""), (6, ""), (None, None), (None, ""), (None, None)]  # no words: all stay
    out = [(r.doc_id, r.text) for r in P.near(spark, make_docs(rows), None).collect()]
    texts = Counter(t for _, t in out)
    assert sum(n for t, n in texts.items() if t) == 5
    assert [sum(texts[t] for t in (" ".join(w), k)) for w, k in zip((a, b, c, d, e), copy, strict=True)] == [1] * 5
    assert (1, " ".join(b)) in out and (9, copy[3]) in out and (5, " ".join(e)) in out
    assert Counter(r for r in out if not r[1]) == {(6, ""): 2, (None, None): 2, (None, ""): 1}


def test_mix_stage(spark, docs):
    want = Counter()
    for (i, _, _, c) in mixed([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()], P.REPEATS)[0]:
        want[i] += c
    out = P.mix(spark, docs, None)
    assert out.columns == COLUMNS and Counter(r.doc_id for r in out.collect()) == +want


def test_stages_take_an_empty_table(spark, docs):
    none = docs.where("doc_id = 99999")
    for _, stage in P.STAGES:
        assert stage(spark, none, None).count() == 0


def test_whole_pipeline(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert language_id.fit([r[1] for r in learn], [r[2] for r in learn]).labels == ["de", "en", "es", "fr"]
    rows = [r for r in rows if any(c.isalpha() for c in r[1])]
    last = {}
    for r in sorted(rows):
        last[r[1]] = r
    rows = list(last.values())
    stay = {i for i, _, c in similar([r[:2] for r in rows]) if i == c}
    want = Counter()
    for i, _, _, c in mixed([r for r in rows if r[0] in stay], P.REPEATS)[0]:
        want[i] += c
    assert Counter(r.doc_id for r in P.run(spark, SF).collect()) == +want
