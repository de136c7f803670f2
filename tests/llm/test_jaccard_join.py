import random

import numpy as np
import pytest

from vettable.llm import jaccard_join as J
from vettable.llm import queries
from vettable.llm.common import components
from . import helpers as H


def shingles(text, k=3):
    w = H.space_words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, percent=90, k=3):
    sets = [shingles(t, k) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(sets[i]), None if d is None else low[find(i)]) for i, (d, _) in enumerate(docs)]


NAMES = ("doc_id", "n_shingles", "component_id")


def key(r):
    return (r[0] is not None, *map(str, r))


def near_copies(rng, n, words=120, edits=4, base=None):
    """Documents around a few bases, with edits that fall on both sides of the threshold."""
    text = base or [[f"w{rng.randrange(4000)}" for _ in range(words)] for _ in range(3)]
    out = []
    for i in range(n):
        w = list(rng.choice(text))
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        out.append((i, " ".join(w)))
    return out


def test_query_equals_brute_force(spark):
    got = H.rows(queries.op6_ngram_jaccard(spark, H.SF), *NAMES)
    assert sorted(got) == sorted(brute(H.rows(H.documents(spark), "doc_id", "text")))


@pytest.mark.parametrize("block", [2000, 7])
def test_near_copies_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK_SETS", block)
    rng = random.Random(block)
    docs = near_copies(rng, 90) + [(1000 + i, t) for i, t in near_copies(rng, 60, 14, 3)]
    docs += [(2000 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(H.rows(J.components_by_jaccard(frame), *NAMES)) == sorted(brute(docs))


@pytest.mark.parametrize("percent", [90, 80, 50])
def test_linked_sets_always_share_a_key(percent):
    rng = np.random.default_rng(4)
    weights, parts = rng.integers(0, 50, J.SLOTS), J.Parts(percent)
    for n in [*range(1, 60), 100, 150, 400, 1000, 3000]:
        for _ in range(12):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            least = -(-percent * n // 100)
            grow = rng.integers(0, 2)
            keep = int(rng.integers(least, n + 1))
            b = a[:keep] if not grow else np.concatenate([a, rng.integers(0, 1 << 63, n * 100 // percent - n, dtype=np.uint64)])
            if not grow and rng.integers(0, 2):  # exchange as many as the threshold lets
                m = n * (100 - percent) // (100 + percent)
                b = np.concatenate([a[:n - m], rng.integers(0, 1 << 63, m, dtype=np.uint64)])
            x, y = np.unique(a), np.unique(b)
            both = len(np.intersect1d(x, y))
            assert 100 * both >= percent * (len(x) + len(y) - both)
            assert len(np.intersect1d(J.prefix_keys(x, weights, percent), J.prefix_keys(y, weights, percent)))
            if len(np.union1d(x, y)) > both:
                assert len(np.intersect1d(parts.keys(x), parts.keys(y)))


def test_passages_that_many_documents_share_make_no_keys(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(150)) + " " + passage) for i in range(400)],
                                 "doc_id long, text string").repartition(5)
    weights = J.shingle_weights(docs, 5)
    assert weights.value.sum() == 400 * 206
    signed = J.shingle_sets(docs, 5, 80, weights)
    keyed = signed.select("id", J.F.explode("keys").alias("key"))
    assert keyed.count() == 400 * (206 - 165 + 1) and keyed.groupBy("key").count().filter("count > 1").count() == 0


def test_one_of_each_stays_whatever_columns_are_called(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4), (3, "x", 5, 6), (3, "x", 5, 6)],
                                 "doc_id long, text string, gone int, Twice int")
    got = J.keep_one_of_each(docs, k=5, percent=80)
    assert got.columns == docs.columns and sorted(H.rows(got, "doc_id", "gone")) == [(1, 1), (3, 5)]


def test_trees_connect_what_brute_force_links():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50), dtype=np.uint64)) for _ in range(40)]
        sets = [J.mix(s) for s in sets]
        sets = [np.sort(s) for s in sets]
        percent = int(rng.integers(20, 80))
        forest = J.Forest(40)
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    forest.join(i, j)
        got = J.Forest(40)
        for a, b in J.block_links([(i, s, i, 0) for i, s in enumerate(sets)], percent):
            got.join(a, b)
        same = [[f.find(i) == f.find(j) for i in range(40) for j in range(i)] for f in (forest, got)]
        assert same[0] == same[1]


def test_awkward_rows_and_keeping_one(spark):
    got = H.rows(J.components_by_jaccard(H.awkward(spark)), *NAMES)
    assert sorted(got, key=key) == sorted(brute(H.AWKWARD), key=key)
    assert J.components_by_jaccard(H.empty(spark)).count() == 0
    kept = J.keep_one_of_each(H.awkward(spark))
    assert kept.columns == H.awkward(spark).columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["1", "2", "3", "None", "None", "4", "5", "6", "7", "-9", "8"])
    assert J.keep_one_of_each(H.empty(spark)).count() == 0


def test_the_driver_plans_few_jobs(spark):
    """The driver's memory grows with the jobs it plans, each with its broadcasts and plans."""
    rng = random.Random(12)
    docs = near_copies(rng, 60, edits=9) + [(100 + i, f"own {i} " + " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(40))) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    spark.sparkContext.setJobGroup("few-jobs", "one of each")
    try:
        kept = sorted(r["doc_id"] for r in J.keep_one_of_each(frame, k=5, percent=80).collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept == sorted(d for d, _, c in brute(docs, 80, 5) if c == d)
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs"))
    assert 0 < n < 240, n


def test_components_of_chains_hubs_and_random_edges(spark):
    rng = random.Random(13)
    for edges in ([(i, i + 1) for i in range(40)], [(100, i) for i in range(60)] + [(5, 200)], [(3, 3)], [],
                  [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(80)] * 2):
        root = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in root:
            for a, b in edges:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        got = components(spark.createDataFrame(edges, "a long, b long"))
        assert sorted(H.rows(got, "id", "root")) == sorted(root.items())


def test_signatures_never_drop_a_link():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 30, 127, 128, 129, 700, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = int(rng.integers(0, n // 9 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 9 + 1)), dtype=np.uint64)]))
            x, y = (np.frombuffer(J.bitmap(v), np.uint64)[None, :] for v in (a, b))
            words = min(x.shape[1], y.shape[1])
            x, y = (J.folded(v, words)[0] for v in (x, y))
            spare = [len(v) - int(np.bitwise_count(w).sum()) for v, w in ((a, x), (b, y))]
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert J.may_link(len(a), x, spare[0], len(b), y, spare[1], 80)
                rows = [(i, len(v), J.bitmap(v), i, 0) for i, v in enumerate((a, b))]
                assert J.possible_members(rows, 80) == [0, 1]
                assert J.possible_members([r[:3] + (5, 0) for r in rows], 80) == []  # one component already
    far = [np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64)) for _ in range(60)]
    assert J.possible_members([(i, len(x), J.bitmap(x), i, i % 2) for i, x in enumerate(far)], 80) == []


def test_small_blocks_and_shares_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    rows = near_copies(rng, 120, edits=9) + [(1000 + i, t) for i, (_, t) in enumerate(near_copies(rng, 60, words=25, edits=5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(J, "BLOCK_SETS", 7)
    for percent, k, keys in ((90, 3, "parts"), (80, 5, "rare"), (80, 5, "parts")):
        got = H.rows(J.components_by_jaccard(docs, k=k, percent=percent, keys=keys), *NAMES)
        assert sorted(got) == sorted(brute(rows, percent, k))


@pytest.mark.parametrize("block", [2_000, 5])
def test_a_set_of_many_open_groups_travels_once(spark, monkeypatch, block):
    # Near copies under and over 80 percent share rare shingles in many groups of different members.
    rng = random.Random(11)
    docs = [(100 * f + i, t) for f in range(3) for i, t in near_copies(rng, 30, words=150, edits=14)]
    sent, joined = [], J._joined

    def watched(rows, percent):
        sent.append(J.written(rows.select("id", "g"), "watched"))
        return joined(rows, percent)
    monkeypatch.setattr(J, "_joined", watched)
    monkeypatch.setattr(J, "BLOCK_SETS", block)
    monkeypatch.setattr(J, "STAR_TURNS", 1)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = H.rows(J.components_by_jaccard(df, k=5, percent=80), *NAMES)
    assert sorted(got) == sorted(brute(docs, 80, 5))
    counts = (sent[0].count(), sent[0].select("id").distinct().count())
    assert counts[0] == counts[1] > 4, counts
