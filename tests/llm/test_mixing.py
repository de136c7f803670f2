import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from vettable.llm import mixing, queries
from . import helpers as H


@pytest.mark.parametrize("seed", range(12))
def test_one_cycle_stays_within_a_block(seed):
    rng = random.Random(seed)
    weights = mixing.rounded_weights({f"s{i}": rng.random() ** 3 + 1e-6 for i in range(rng.randrange(1, 40))}, 300)
    assert sum(weights.values()) == 1 and min(weights.values()) >= Fraction(1, 300)
    units, cycle = mixing.exact_units(weights)
    slots = mixing.one_cycle(units, cycle)
    assert sorted(t for v in slots.values() for t in v) == list(range(cycle))
    owner = {t: s for s, v in slots.items() for t in v}
    got = Counter()
    for t in range(cycle):
        got[owner[t]] += 1
        assert all(abs(got[s] - w * (t + 1)) < 1 for s, w in weights.items())
    for s, v in slots.items():
        for j, t in enumerate(v, 1):
            assert (j - 1) / weights[s] // 1 <= t < -(-j / weights[s] // 1)


@pytest.mark.parametrize("weights", [
    {"hot": Fraction(10, 29)} | {f"s{i}": Fraction(1, 29) for i in range(19)},
    {"rare": 0.0001, "a": 0.3333, "b": 0.6666},
    {"a": Fraction(1, 3), "b": Fraction(2, 7), "c": Fraction(1, 11), "d": Fraction(67, 231)},
    {"a": 2, "b": 3.5, "c": 1e-3},
])
def test_awkward_weights_hold_over_many_cycles(weights):
    units, cycle = mixing.exact_units(weights)
    share = {s: Fraction(str(w)) for s, w in weights.items()}
    share = {s: w / sum(share.values()) for s, w in share.items()}
    owner = {t: s for s, v in mixing.one_cycle(units, cycle).items() for t in v}
    got = Counter()
    for t in range(max(60_000, 3 * cycle)):
        s = owner[t % cycle]
        got[s] += 1
        if t % 97 == 0 or t > 59_000:
            assert all(abs(got[x] - w * (t + 1)) < 1 for x, w in share.items())


def test_weights_without_a_small_denominator_are_refused():
    with pytest.raises(ValueError, match="rounded_weights"):
        mixing.exact_units({"a": 0.1234567891, "b": 0.3})
    assert mixing.exact_units({}) == ({}, 0) and mixing.exact_units({"a": 0.0}) == ({}, 0)
    assert mixing.exact_units({"a": 0.1}) == ({"a": 1}, 1)


def earliest_deadline_first(share, n):
    """The source of each of ``n`` slots, by a plain simulation over exact fractions."""
    done, out = Counter(), []
    for t in range(n):
        ready = [(-(-(done[s] + 1) / w // 1), s) for s, w in share.items() if done[s] / w // 1 <= t]
        s = min(ready)[1]
        done[s] += 1
        out.append(s)
    return out


def brute(rows, share, block_chars):
    """(doc, block, slot) from plain loops; rows are (doc, key, size, hash)."""
    at, blocks = defaultdict(int), {}
    for d, s, n, h in sorted(rows, key=lambda r: (r[1], r[3] % mixing.BUCKETS, r[3])):
        blocks[d] = (s, at[s] // block_chars + 1)
        at[s] += n
    most = max(b / share[s] for s, b in blocks.values())
    slots = defaultdict(list)
    for t, s in enumerate(earliest_deadline_first(share, int(most) + 2)):
        slots[s].append(t)
    return {d: (b, slots[s][b - 1]) for d, (s, b) in blocks.items()}


def test_query_is_whole_and_equals_a_replay(spark):
    got = queries.op7_source_mix(spark, H.SF)
    hashes = H.documents(spark).selectExpr(
        "doc_id", "'=' || source s", "greatest(length(text), 1) n", "xxhash64('mix', doc_id) h")
    rows = H.rows(hashes, "doc_id", "s", "n", "h")
    sizes = Counter()
    for _, s, n, _ in rows:
        sizes[s] += n
    share = mixing.rounded_weights({s: n ** 0.5 for s, n in sizes.items()})
    root = sum(n ** 0.5 for n in sizes.values())
    assert all(abs(w - sizes[s] ** 0.5 / root) <= 1 / mixing.RESOLUTION for s, w in share.items())
    want = brute(rows, share, mixing.BLOCK_CHARS)
    found = {d: (b, t) for d, b, t in H.rows(got, "doc_id", "block", "slot")}
    assert found == want
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got.collect())


def test_balance_of_many_blocks_with_a_hot_source(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("aaaaaaabc"), "x" * rng.randrange(1, 60)) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    weights = {"a": 0.2, "b": 0.5, "c": 0.3}
    got = mixing.schedule(docs, weights, block_chars=100).collect()
    assert len(got) == 3000
    owner = {r["slot"]: r["source"] for r in got}
    limit = max(r["slot"] for r in got if r["balanced"]) + 1
    assert limit > 20 and all((r["slot"] < limit) == r["balanced"] for r in got)
    n = Counter()
    for t in range(limit):
        n[owner.get(t)] += 1  # no empty slot while all sources have blocks (a block without a start is rare)
        assert all(abs(n[s] - w * (t + 1)) < 1 for s, w in weights.items())


def test_awkward_rows(spark):
    docs = H.awkward(spark).withColumnRenamed("n_words", "slot")
    out = mixing.schedule(docs, {"s": 1.0, "absent": 2.0})
    assert out.count() == len(H.AWKWARD) and out.columns.count("slot") == 1
    assert {r["slot"] is None for r in out.collect()} == {False}
    nulls = docs.selectExpr("doc_id", "text", "cast(null as string) source").union(
        docs.selectExpr("doc_id", "text", "'t'"))
    got = mixing.schedule(nulls, {None: 1.0}).collect()
    assert {(r["source"], r["slot"] is None, r["balanced"]) for r in got} == {(None, False, True), ("t", True, False)}
    assert mixing.schedule(H.empty(spark)).count() == 0
    assert mixing.in_mixed_order(H.empty(spark)).count() == 0
    mixed = mixing.in_mixed_order(docs)
    assert mixed.columns == docs.columns and mixed.count() == len(H.AWKWARD)


def test_no_python_in_the_plan(spark):
    plan = queries.op7_source_mix(spark, H.SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_documents_longer_than_a_block_move_the_balance_by_one_document_at_most(spark):
    rng = random.Random(11)
    data = [(i, "ab"[i % 2], "x" * (5_000 if i == 6 else rng.randrange(1, 60))) for i in range(1200)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    got = sorted((r["slot"], r["source"], len(r["text"]), r["balanced"]) for r in
                 mixing.schedule(docs, {"a": 0.5, "b": 0.5}, block_chars=100).collect())
    limit = max(t for t, _, _, ok in got if ok) + 1
    size, at = Counter(), 0
    for t in range(limit):
        while at < len(got) and got[at][0] == t:
            size[got[at][1]] += got[at][2]
            at += 1
        assert all(abs(size[s] - 50 * (t + 1)) < 100 + 5_000 for s in "ab")
