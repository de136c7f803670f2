import zlib

import numpy as np
import pytest

from vettable.llm import language, quality, queries
from . import helpers as H


def fold(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 0


def auc(scores, y):
    order = np.argsort(np.argsort(scores))
    y = np.array(y)
    return (order[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op1_compression_quality(spark, sf).collect()}
    assert len(got) == 1000 and all(fold(d) == r["held_out"] for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    labels = H.rows(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "quality")
    held = [(got[d]["score"], q) for d, q in labels if d in got and got[d]["held_out"]]
    assert auc([s for s, _ in held], [q for _, q in held]) > 0.9


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (7, None), (8, 5)],
                                   "doc_id long, quality int")
    docs = spark.createDataFrame([(i, ("good plain words here " if i % 2 else "B!! A!! D!! ") * (5 + i % 7))
                                  for i in range(200)], "doc_id long, text string")
    model = quality.fit_quality(docs, labels)
    out = quality.score_quality(H.awkward(spark), model)
    assert out.count() == len(H.AWKWARD) and out.columns.count("score") == 1
    for r in out.collect():
        assert 0 <= r["score"] <= 1 and (r["text"] or r["score"] == pytest.approx(model.base))
    assert quality.score_quality(H.empty(spark), model).count() == 0
    only = quality.fit_quality(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in quality.score_quality(docs, only).collect()} == {1.0}
    none = quality.fit_quality(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_language_id(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.95


def test_language_edge_cases(spark):
    train = spark.createDataFrame(
        [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(60)]
        + [(i, None, "fr") for i in range(90, 99)] + [(100, "les mots", None)], "doc_id long, text string, lang string")
    model = language.fit_language(train)
    assert model.languages == ["de", "en", "fr"]
    out = language.predict_language(H.awkward(spark), model)
    for r in out.collect():
        want = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == want and 0 <= r["score"] <= 1
    assert language.predict_language(H.empty(spark), model).count() == 0
    assert model.predict("und der hund")[0] == "de" and model.predict("the dog")[0] == "en"
    assert (model.weights == 0).mean() > 0.9
    nothing = language.fit_language(train.limit(0))
    assert {r["lang_pred"] for r in language.predict_language(train, nothing).collect()} == {"und"}
    single = language.fit_language(train.filter("lang = 'en'"))
    assert single.predict("der hund") == ("en", 1.0)
