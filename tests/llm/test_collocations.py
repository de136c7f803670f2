import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vettable.llm import collocations as C
from . import helpers as H

ID = st.integers(C.FIRST_ID, 2 ** 64 - 1)


@given(st.integers(2, 3).flatmap(lambda w: st.lists(st.tuples(*[ID] * w), min_size=1, max_size=40)))
@settings(deadline=None)
def test_permutation_is_invertible(grams):
    limbs = [np.array(x, np.uint64) for x in zip(*grams)]
    assert [x.tolist() for x in C.unpermute(C.permute(limbs))] == [x.tolist() for x in limbs]


@given(st.integers(2, 3).flatmap(lambda w: st.dictionaries(st.tuples(*[ID] * w), st.integers(1, 2 ** 40), max_size=60)),
       st.integers(0, 5))
@settings(deadline=None)
def test_filters_lose_nothing(table, block_bits):
    grams = list(table)
    if not grams:
        return
    limbs = [np.array(x, np.uint64) for x in zip(*grams)]
    got = Counter()
    for block, raw in C.filters(limbs, np.array(list(table.values()), np.int64), block_bits):
        ids, counts = C.decode_filter(raw, block_bits)
        assert block_bits == 0 or set((ids[0] >> np.uint64(64 - block_bits)).tolist()) == {block}
        assert ids[0].tolist() == sorted(ids[0].tolist())
        for g, n in zip(zip(*[x.tolist() for x in C.unpermute(ids)]), counts.tolist()):
            got[g] += n
    assert got == Counter(table)


def test_entries_that_share_the_leading_id_stay_apart():
    limbs = [np.array([7, 7, 7, 5], np.uint64), np.array([2, 1, 2, 9], np.uint64)]
    (a, b), n = C.sorted_sums(limbs, np.array([1, 10, 100, 1000]))
    assert (a.tolist(), b.tolist(), n.tolist()) == ([5, 7, 7], [9, 1, 2], [1000, 10, 101])


def brute(rows, least=10, share=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting tuples of words."""
    counts, out = {}, []
    for lang, text in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", H.lower_az(text)):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                f.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longer = Counter()
        for g, a in cand.items():
            if len(g) == 3:
                for x in (g[:2], g[1:]):
                    longer[x] = max(longer[x], a)
        found = []
        for g, a in cand.items():
            if g in longer and 100 * longer[g] >= share * a:
                continue
            s, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-s, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def result(docs, **given_):
    return sorted(H.rows(C.top_phrases(C.collocations(docs, **given_)), *NAMES))


def test_against_brute_force(spark):
    docs = H.documents(spark)
    want = brute(H.rows(docs, "lang", "text"))
    assert len(want) > 100 and result(docs) == want


def test_small_shards_and_windows_give_the_same(spark, monkeypatch):
    docs = H.documents(spark)
    want = result(docs, least=4)
    for name, value in (("TASK_WORDS", 500), ("TASK_GRAMS", 700), ("BUFFER", 300), ("WINDOW", 64), ("BLOCK_BYTES", 1 << 12)):
        monkeypatch.setattr(C, name, value)
    shard = C.Shard(0, 2, None)
    for _ in shard.add(b"a b c " * 100):
        pass
    assert shard.seen.sum() == 300
    assert want == brute(H.rows(docs, "lang", "text"), least=4)
    rows = [r for size in (2, 3) for r in _local(H.rows(docs, "lang", "text"), size)]
    assert rows == [(lang, g, n) for size in (2, 3) for lang, g, n in _counted(H.rows(docs, "lang", "text"), size)]


def _local(rows, size):
    """Phrase counts of small shards merged in this process, as ids."""
    full = np.full(1 << 12, 255, np.uint8)
    got = {}
    for lang, text in rows:
        shard = got.setdefault(lang, (C.Shard(0, size, full), Counter()))
        for _ in shard[0].add((text or "").encode() + b"\n"):
            if shard[0].full():
                _empty(shard, lang)
    for lang, shard in got.items():
        _empty(shard, lang)
    return sorted((lang, g, n) for lang, (_, c) in got.items() for g, n in c.items())


def _empty(shard, lang):
    for batch in shard[0].rows(lang, 3):
        for raw in batch.column("filter").to_pylist():
            if raw is not None:
                ids, counts = C.decode_filter(raw, 3)
                for g, n in zip(zip(*[x.tolist() for x in C.unpermute(ids)]), counts.tolist()):
                    shard[1][g] += n


def _counted(rows, size):
    import xxhash

    f = {}
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", H.lower_az(text)):
            w = [xxhash.xxh64_intdigest(x.encode(), 0) for x in re.findall("[^ \t]+", piece)]
            f.setdefault(lang, Counter()).update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    return sorted((lang, g, n) for lang, c in f.items() for g, n in c.items())


def test_drop_rule_ties_and_overlaps(spark):
    rows = ([("x", "a b c")] * 10 + [("x", "a b")] * 10 + [("x", "b c d")] * 9 + [(None, "t t t t")] * 6
            + [("y", "p q.")] * 10 + [("y", "r s.")] * 10 + [("y", "P\tq;x")])
    docs = spark.createDataFrame([(t, lang, "l", 1) for lang, t in rows], "text string, lang string, phrase string, n int")
    got = result(docs)
    assert got == brute(rows)
    assert [r[2] for r in got if r[0] == "x"] == ["a b c"]  # "a b" has 20 and "a b c" 10: half, so it goes
    assert [r[2:4] for r in got if r[0] == "und"] == [("t t t", 12)]
    assert [r[2] for r in got if r[0] == "y"] == ["p q", "r s"]


def test_hash_collisions_take_the_next_seed(spark, monkeypatch):
    import xxhash

    real = xxhash.xxh64_intdigest
    docs = H.documents(spark).select("lang", "text")
    shards, words, seed = C.counted_words(docs, 0)
    assert seed == 0
    clash = words.limit(1).withColumnRenamed("word", "w")
    assert words.groupBy("lang", "id").count().filter("count > 1").count() == 0
    twice = words.unionByName(clash.selectExpr("lang", "cast('other' as binary) word", "id", "n"))
    assert twice.groupBy("lang", "id").count().filter("count > 1").count() == 1 and real is xxhash.xxh64_intdigest


def test_large_counts_stay_exact(spark):
    a, l, r = 999_999_999_999_989, 999_999_999_999_999_877, 1_000_000_000_000_037
    row = spark.createDataFrame([(a, l - 1, r - 1)], "a long, l long, r long").select(
        C._score(*[C.F.col(x) for x in "alr"]).alias("s")).first()
    assert row.s.score == 1_000_000 * a * a // ((l - 1) * (r - 1))


def test_awkward_and_empty_tables(spark):
    docs = H.awkward(spark).withColumnRenamed("source", "lang")
    assert result(docs) == brute(H.rows(docs, "lang", "text"))
    assert result(H.empty(spark).withColumnRenamed("source", "lang")) == []
