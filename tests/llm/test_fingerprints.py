import hashlib
import random
import struct

import xxhash

from vettable.llm import fingerprints as P
from vettable.llm import queries
from . import helpers as H


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hash_array(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
    return signed(seed)


def sketch(text, k=P.K, inner=P.INNER, m=P.SKETCH):
    h = [signed(xxhash.xxh64_intdigest(text[i:i + inner].encode(), seed=42)) for i in range(len(text) - inner + 1)]
    w = k - inner + 1
    at = [i for i in range(len(text) - k + 1) if min(h[i:i + w]) in (h[i], h[i + w - 1])]
    places = {}
    for i in at:
        places.setdefault(hash_array([h[i], h[i + w // 2], h[i + w - 1]]), i)
    if not at and text:
        places = {signed(xxhash.xxh64_intdigest(text.encode(), seed=42)): 0}
    return dict(sorted(places.items())[:m])


def like(a, b, m=P.SKETCH):
    union = sorted({*a, *b})[:m]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def show(s):
    return ",".join(f"{x & (1 << 64) - 1:016x}:{p}" for x, p in s.items())


def brute(docs):
    order = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, e = sketch(t), sketch(edited)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(e),
                    like(a, e), like(a, sketch(nxt))))
    return out


NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_DOCS", 30)  # several ranges
    got = H.rows(queries.op8_syncmer_fingerprints(spark, H.SF), *NAMES)
    want = brute(H.rows(H.documents(spark), "doc_id", "text"))
    assert sorted(got) == sorted(want)
    near = [r[5] for r in got if r[1] > 500]
    assert all(r[5] > 0 for r in got if r[1] >= 120)
    assert sum(near) / len(near) > 0.2 + sum(r[6] for r in got) / len(got)


def test_awkward_rows(spark, monkeypatch):
    key = lambda r: (r[0] is not None, r)
    for size in (4000, 3):
        monkeypatch.setattr(P, "RANGE_DOCS", size)
        got = H.rows(P.edit_likeness(H.awkward(spark)), *NAMES)
        assert sorted(got, key=key) == sorted(brute(H.AWKWARD), key=key)
    assert P.edit_likeness(H.empty(spark)).count() == 0
    out = P.fingerprint(H.awkward(spark), out="score")
    assert out.columns.count("score") == 1
    assert sorted(H.rows(out, "score")) == sorted((show(sketch(t or "")),) for _, t in H.AWKWARD)


def test_short_texts_and_texts_without_blanks_are_like_their_edited_texts(spark):
    rng = random.Random(3)
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(480))
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    emoji = "".join(rng.choice("\U0001f600\U0001f601\U0001f602ab") for _ in range(200))
    texts = [chinese, letters, emoji, "Only a few words stand in this short text, but half of it is kept.",
             "Another short text of ten words or so, no more.", "unlike all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.edit_likeness(docs).collect()}
    assert all(got[i]["near_edited"] > 0.1 for i in range(5))
    assert all(got[i]["near_next"] == 0 for i in range(6))
    assert sorted(H.rows(P.edit_likeness(docs), *NAMES)) == sorted(brute(list(enumerate(texts))))


def test_ranges_count_the_bounds_below(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_DOCS", 7)
    ids = spark.range(0, 3000, 3).selectExpr("id * id AS doc_id").union(spark.sql("SELECT CAST(NULL AS LONG)"))
    got = sorted(((d is not None, d or 0), r) for d, r in H.rows(ids.withColumn("r", P._ranges(ids)), "doc_id", "r"))
    ranges = [r for _, r in got]
    assert ranges == sorted(ranges) and len(set(ranges)) > 100 and max(map(ranges.count, ranges)) < 30


def test_no_python_in_the_plan(spark):
    plan = queries.op8_syncmer_fingerprints(spark, H.SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_hashes_are_sorted_natively(spark):
    # array_sort compares by an interpreted lambda, also without a comparator; sort_array sorts longs.
    plan = P.edit_likeness(H.awkward(spark))._jdf.queryExecution().analyzed().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
