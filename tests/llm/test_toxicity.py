from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import toxicity as T
from tests.llm.conftest import SF

SF_01 = SF.replace("0.001", "0.1")


def test_held_out_accuracy():
    rows = duckdb.sql(f"SELECT doc_id, text, toxic FROM '{SF_01}/documents.parquet' JOIN '{SF_01}/labels.parquet' USING (doc_id)").fetchall()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    learn, test = [r for r in rows if not held(r[0])], [r for r in rows if held(r[0])]
    model = T.fit([r[1] for r in learn], np.array([r[2] for r in learn], float), T.IDENTITY_TERMS)
    score = model.scores(pa.array([r[1] for r in test]))
    toxic = np.array([r[2] for r in test]) == 1
    assert (score[toxic] >= 0.5).mean() >= 0.85
    assert (score[~toxic] >= 0.5).mean() <= 0.02


def test_swaps_move_scores_less_with_the_penalty(words):
    rng = random.Random(1)
    texts, labels = [], []
    for k in range(400):
        w = words(20, k)
        toxic = k % 2
        if toxic:
            w.insert(3, rng.choice(["awful", "vile", "nasty"]))
        if rng.random() < (0.8 if toxic else 0.1):  # one group is named mostly in toxic texts
            w.insert(7, "muslims")
        elif rng.random() < 0.5:
            w.insert(7, "christians")
        texts.append(" ".join(w))
        labels.append(toxic)
    y = np.array(labels, float)
    probe = [" ".join([*words(15, 900 + k), term]) for k in range(20) for term in ("muslims", "christians")]

    def gap(model):
        z = model.scores(pa.array(probe)).reshape(-1, 2)
        return np.abs(z[:, 0] - z[:, 1]).mean()

    free, tied = T.fit(texts, y, T.IDENTITY_TERMS, penalty=0.0), T.fit(texts, y, T.IDENTITY_TERMS, penalty=20.0)
    assert gap(tied) < 0.25 * gap(free)
    assert (tied.scores(pa.array(["x y awful vile"])) > 0.5).all()


def test_swapped():
    out, origin = T.swapped(["A Woman here", "none"], [["woman", "man", "girl"]])
    assert out == ["a man here", "a girl here"] and origin == [0, 0]


@pytest.mark.parametrize("label", [0, 1])
def test_one_label_only(make_docs, spark, label):
    docs = make_docs([(k, f"text {k}") for k in range(5)] + [(None, None), (1, "")])
    labels = spark.createDataFrame([(k, label) for k in range(5)] + [(None, 1), (77, 1), (2, None)], "doc_id bigint, toxic int")
    out = T.toxicity(docs, labels, F.lit(True)).collect()
    assert len(out) == 7 and all(abs(r.score - label) < 1e-3 for r in out)
    none = T.toxicity(docs, labels.where("doc_id = 1000"), F.lit(True)).collect()
    assert len(none) == 7 and all(r.score < 1e-3 for r in none)
    assert T.toxicity(docs.where("doc_id = 99"), labels, F.lit(True)).count() == 0
