import pytest

from vettable.llm import license_scan as L
from vettable.llm import queries
from . import helpers as H


def brute(text, templates):
    w = H.words(text)
    best, places = {}, set()
    for k, t in enumerate(templates):
        n, need = len(t.words), t.need
        for s in range(0, max(1, len(w)), n):
            block = w[s:s + 2 * n]
            have = set(block) & set(t.words)
            if len(have) < need or s and not block:
                continue
            if f" {' '.join(t.name)} " not in f" {' '.join(block)} " and t.name:
                continue
            if t.exact:
                at = [s + i for i in range(len(block) - n + 1) if tuple(block[i:i + n]) == t.words]
                if not at:
                    continue
                places |= {(k, a) for a in at}
            best[k] = max(best.get(k, 0), len(have) / len(set(t.words)))
    at = [a for _, a in places]
    base = sorted({templates[k].label for k, _ in places})
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(base),
            ",".join(sorted({templates[k].label for k in best})), max(best.values(), default=0.0))


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def test_query_equals_brute_force(spark):
    got = queries.op9_license_scan(spark, H.SF)
    texts = dict(H.rows(H.documents(spark), "doc_id", "text"))
    rows = H.rows(got, "doc_id", *NAMES)
    assert len(rows) == len(texts) and any(r[2] for r in rows) and any("apache" in r[6] for r in rows)
    for d, *r in rows:
        assert tuple(r) == brute(texts[d], L.default_templates())


def test_base_places_are_plain_occurrences(spark):
    text = "CC-BY cc by, by CC BY? all rights reserved all rights. General Public License " + "x " * 30 + "cc\nby"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "cc"), (4, "cc")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.scan_licenses(docs).collect()}
    w = H.words(text)
    want = [i for _, p in L.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    r = got[1]
    assert (r["n_base"], r["first_word"], r["last_word"]) == (len(want), min(want), max(want))
    assert r["base_labels"] == "cc-by,gpl,reserved" and r["score"] == 1.0
    assert (got[2]["n_words"], got[2]["labels"], got[2]["score"], got[2]["first_word"]) == (0, "", 0.0, None)


def test_awkward_rows(spark):
    out = L.scan_licenses(H.awkward(spark))
    texts = H.rows(out, "text", *NAMES)
    assert len(texts) == len(H.AWKWARD) and out.columns.count("labels") == 1
    for t, *r in texts:
        assert tuple(r) == brute(t, L.default_templates())
    assert L.scan_licenses(H.empty(spark)).count() == 0


PAIRS = [  # text, the labels it should get
    ("This work is released under the GPL license.", ""),
    ("Licensed under the MIT license, version 2.0 of the manual", "mit"),
    ("the license under which it was released", ""),
    ("Licensed under the Apache License, Version 1.1", ""),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("the MIT campus was released from the license under which it stood", ""),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
     "accompanying documentation covered by this license to use, reproduce and transmit the software", ""),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
     "by the Free Software Foundation", "gpl,lgpl-notice"),
    ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
     "by the Free Software Foundation", "agpl-notice,gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation", "gpl,gpl-notice"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike International License", ""),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted.", ""),
]


@pytest.mark.parametrize("lead", ["", "Some words of the host stand before the notice and go on for a while here. "])
def test_licenses_of_like_wording_are_told_apart(spark, lead):
    docs = spark.createDataFrame([(i, lead + t + " And more follows.") for i, (t, _) in enumerate(PAIRS)],
                                 "doc_id long, text string")
    got = dict(H.rows(L.scan_licenses(docs), "doc_id", "labels"))
    assert [got[i] for i in range(len(PAIRS))] == [w for _, w in PAIRS]


def test_each_notice_is_found_in_full_and_slightly_changed(spark):
    rows = []
    for i, (label, name, words) in enumerate(L.NOTICES):
        rows.append((i, label, "host words " * 9 + words + " and a tail"))
        seq = words.split()
        if len(set(seq)) >= L.SHORT:  # a word outside the name replaced
            at = next(j for j, w in enumerate(seq) if w not in name.split())
            rows.append((100 + i, label, " ".join(seq[:at] + ["other"] + seq[at + 1:])))
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = dict(H.rows(L.scan_licenses(docs), "doc_id", "labels"))
    assert all(label in got[i].split(",") for i, label, _ in rows)
