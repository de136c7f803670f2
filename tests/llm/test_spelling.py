import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from vettable.llm import spelling as S
from . import helpers as H

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(rows):
    n = Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            w = H.lower_az(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6}


def one_edit(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def brute(rows):
    n = {w: c for w, c in brute_counts(rows).items() if c >= 5}
    near = defaultdict(list)
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    for w in n:
        for size in (len(w), len(w) + 1):
            for v in by_length[size]:
                if (size > len(w) or w < v) and one_edit(w, v):
                    near[w].append(v)
                    near[v].append(w)
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v))
        if n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def test_against_brute_force(spark):
    docs = H.documents(spark)
    got = sorted(H.rows(S.spelling_forms(docs), *NAMES))
    want = brute(H.rows(docs, "doc_id", "text"))
    assert got == want
    assert sum(r[1] is not None for r in want) >= 20


@given(st.lists(st.text(alphabet="aZé×ÿ Ā\u0080.漢9ʼ", max_size=30), max_size=5))
@settings(deadline=None)
def test_runs(texts):
    for t in texts:
        assert [r.decode() for r in S.runs(t.encode())] == [H.lower_az(r) for r in RUN.findall(t)]


WORD = st.text(alphabet="abcé", min_size=1, max_size=14)


@given(WORD, st.integers(0, 14), st.sampled_from("abcéx"), st.integers(0, 2))
@settings(deadline=None, max_examples=400)
def test_one_edit_always_shares_a_key(word, at, letter, kind):
    at %= len(word)
    other = [word[:at] + letter + word[at:], word[:at] + word[at + 1:], word[:at] + letter + word[at + 1:]][kind]
    if other == word or not other:
        return
    x, y = sorted((word, other), key=lambda w: (len(w), w))
    assert S.chunk_keys(x) & S.gram_keys(y)


def test_chains_ties_and_counts(spark):
    text = " ".join(["kitten"] * 5 + ["kittens"] * 25 + ["kittena"] * 25 + ["mittens"] * 125 + ["mitens"] * 4
                    + ["Straße"] * 30 + ["strasse"] * 6 + ["straße"] * 0 + ["Straéße"] * 6)
    docs = spark.createDataFrame([(10_000 + i, t, "w", "n", 3) for i, t in enumerate([text, None, ""])],
                                 "doc_id long, text string, word string, form string, n int")
    got = {r[0]: r[1:] for r in H.rows(S.spelling_forms(docs), *NAMES)}
    assert sorted((w, *r) for w, r in got.items()) == brute(H.rows(docs, "doc_id", "text"))
    assert got["kitten"][:2] == ("kittena", "kittena") and got["kitten"][3] == 2
    assert got["kittens"][:2] == ("mittens", "mittens") and "mitens" not in got
    assert got["straéße"][0] == "straße" and got["strasse"][0] is None


def test_roots_of_long_chains(spark):
    chain = [f"w{i:03}" for i in range(40)]
    rows = [(w, 1, 1, f, 1) for w, f in zip(chain, chain[1:])] + [(chain[-1], 1, 0, None, None), ("alone", 1, 0, None, None)]
    forms = spark.createDataFrame(rows, "word string, n long, n_near long, form string, form_n long")
    roots = dict(H.rows(S.follow(forms), "word", "root"))
    assert roots == {w: chain[-1] for w in chain} | {"alone": "alone"}


def test_small_task_counters_give_the_same(spark, monkeypatch):
    want = brute_counts(H.AWKWARD)
    monkeypatch.setattr(S, "TASK_WORDS", 1)
    assert dict(H.rows(S.count_words(H.awkward(spark)), "word", "n")) == want


def test_awkward_and_empty_tables(spark):
    docs = H.awkward(spark)
    assert sorted(H.rows(S.spelling_forms(docs), *NAMES)) == brute(H.AWKWARD)
    assert S.spelling_forms(H.empty(spark)).collect() == []
