import zlib

import numpy as np

import corpus_pipeline as C
from vettable.llm import mixing
from vettable.llm.common import written
from . import helpers as H
from .test_decontaminate import brute as contaminated
from .test_jaccard_join import brute as jaccard
from .test_token_files import reference


def test_each_stage_against_brute_force(spark):
    docs = H.documents(spark)
    names = docs.columns
    out = {}
    for name, stage in C.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, before, H.SF), f"test-{name}")
        assert docs.columns == names
        out[name] = (before, docs)
    pairs = lambda d: H.rows(d, "doc_id", "text")

    before, after = out["quality"]
    labels = dict(H.rows(spark.read.parquet(f"{H.SF}/labels.parquet"), "doc_id", "quality"))
    kept = {d for d, _ in pairs(after)}
    assert kept <= {d for d, _ in pairs(before)}
    assert np.mean([d in kept for d, q in labels.items() if q == 1]) > 0.9

    before, after = out["near_duplicates"]
    want = sorted(d for d, n, c in jaccard(pairs(before), percent=80, k=5) if d == c)
    assert sorted(d for d, _ in pairs(after)) == want

    before, after = out["decontamination"]
    items = H.rows(spark.read.parquet(f"{H.SF}/benchmark.parquet"), "item_id", "text")
    report = {r[0]: r for r in contaminated(pairs(before), items)}
    got = dict(pairs(after))
    for d, t in pairs(before):
        _, n, hit, _, _, bad = report[d]
        assert (d in got) == (n == 0 or hit < 0.5 * n)
        if d in got:
            assert (got[d] != t) == bad and (not bad or len(H.words(got[d])) == n - hit)
    assert any(r[5] for r in report.values())
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())

    before, after = out["mix"]
    assert sorted(pairs(before)) == sorted(pairs(after))
    slots = dict(H.rows(mixing.schedule(before), "doc_id", "slot"))
    order = [r["doc_id"] for r in C.row_order(after).orderBy("_part", "_row").collect()]
    assert [slots[d] for d in order] == sorted(slots.values())

    rows = {r["doc_id"]: r for r in C.token_stage(spark, after, H.SF).collect()}
    texts, start = dict(pairs(after)), 0
    for d in order:
        ids = reference(texts[d]) + [C.END_ID]
        r = rows[d]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(rows) == len(order)


def test_near_duplicates_link_at_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(105)]
    edited = [*words[:50], "x", *words[51:70], "y", *words[71:]]  # 10 of 101 five-word shingles differ: 91 / 111
    far = [*words[:20], "x", *words[21:50], "y", *words[51:80], "z", *words[81:]]  # 15 differ: 86 / 116
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([words, edited, far])], "doc_id long, text string")
    assert sorted(H.rows(C.near_duplicate_stage(spark, docs, H.SF), "doc_id")) == [(0,), (2,)]


def test_run_gives_the_last_stage(spark):
    got = C.run(spark, H.SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and 0 < got.count() <= 200


def test_stages_on_awkward_and_empty_tables(spark):
    for docs in (H.awkward(spark), H.empty(spark)):
        for name, stage in C.STAGES:
            before, docs = docs, written(stage(spark, docs, H.SF), f"edge-{name}")
            assert name == "token_ids" or docs.columns == before.columns
