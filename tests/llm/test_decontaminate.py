import hashlib
import random

from vettable.llm import decontaminate as D
from vettable.llm import queries
from . import helpers as H


def brute(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = H.words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i:i + window]), set()).add(item)
    lengths = sorted({len(k) for k in wins})
    out = []
    for d, text in docs:
        w, hit, found = H.words(text), set(), set()
        for i in range(len(w)):
            for n in lengths:
                items_ = wins.get(tuple(w[i:i + n])) if i + n <= len(w) else None
                if items_:
                    hit.update(range(i, i + n))
                    found |= items_
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


NAMES = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_query_equals_brute_force(spark):
    got = H.rows(queries.op2_benchmark_decontamination(spark, H.SF), *NAMES)
    items = H.rows(spark.read.parquet(f"{H.SF}/benchmark.parquet"), "item_id", "text")
    want = brute(H.rows(H.documents(spark), "doc_id", "text"), items)
    assert sorted(got) == sorted(want) and any(r[5] for r in got)


def test_small_alphabet_with_short_items_and_blocks(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 4, 5, 9, 14]))) for i in range(2, 30)]
    items += [(2, items[0][1]), (31, None), (32, ""), (33, "!!"), (None, text(6))]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute(docs, items, 4))
    for words in (10_000, 12):
        got = D.contamination(frame, bench, window=4, block_words=words)
        assert sorted(H.rows(got, *NAMES)) == want


def test_awkward_rows_and_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "Kept start. One TWO, three four five six seven eight nine ten! " + "the rest stays " * 9),
         (2, item), (3, None), (4, ""), (5, "clean\n text"), (5, "clean\n text")], "doc_id long, text string")
    got = {(r["doc_id"], r["text"]) for r in D.decontaminate(docs, bench).collect()}
    assert got == {(1, "Kept start. ! " + "the rest stays " * 9), (3, None), (4, ""), (5, "clean\n text")}
    assert D.decontaminate(docs, bench).columns == docs.columns
    odd = D.contamination(H.awkward(spark), bench)
    assert odd.filter("contaminated").count() == 0 and odd.count() == len(H.AWKWARD)
    assert D.contamination(H.empty(spark), bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_a_whole_short_item_is_cut(spark):
    items = spark.createDataFrame([("s", "six words make one short item")], "item_id string, text string")
    host = "A long host text of many plain words goes on and on, "
    docs = spark.createDataFrame([(1, host + "Six words make one short item, and ends."), (2, host + "six words make one."),
                                  (3, host)], "doc_id long, text string")
    assert dict(H.rows(D.contamination(docs, items), "doc_id", "n_hit")) == {1: 6, 2: 0, 3: 0}
    clean = D.decontaminate(docs, items)
    assert dict(H.rows(clean, "doc_id", "text")) == {1: host + ", and ends.", 2: host + "six words make one.", 3: host}
    assert not any(r["contaminated"] for r in D.contamination(clean, items).collect())
