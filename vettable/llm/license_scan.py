r"""Operator 9: license scan as an exact set-similarity join of text blocks and templates.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the A-Z-lowered text. A template
is a set ``T`` of words with a containment threshold; a text block is a window of
``2 * n`` consecutive words, with starts every ``n`` words, where ``n`` is the
template's length in words, so any stretch of ``n`` words lies inside a block. A
block ``B`` matches when ``|B & T| >= threshold * |T|``. The join finds every such
pair:

* words are ordered by their frequency over all documents, rarest first;
* prefix filter: a matching block holds one of the ``|T| - need + 1`` rarest
  words of ``T`` (``need`` = the least matching overlap), so only blocks around
  such words are looked at;
* length filter: the block must hold ``need`` distinct words of any template;
* positional filter: when the rarest word of ``T`` in the block is the i-th of
  the order, at most ``|T| - i`` words can match;
* the overlap of what remains is counted exactly.

A notice names its license: its ``name`` words must stand consecutively in the
block, for the other words of notices (grants, disclaimers) are common to many
licenses; a notice of fewer than ``SHORT`` distinct words must be there in full.
Wording that several licenses share has a label of the family (``bsd-style``).
Phrase templates have threshold 1 and, in addition, each place where the words
stand consecutively is reported. Two passes over the texts, no shuffle of
texts: word counts (of template words only; they are added up over all
documents), then the scan. The templates are a fixed, small list.

Defined results: null and empty texts have no words, no labels and score 0;
repeated rows are reported each; the places of a phrase are counted once though
blocks overlap. Columns of ``docs`` stay; columns with the names of the results
are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, ascii_words, map_arrow, raw_texts

# The base phrases with their labels.
PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
# Notices of public licenses: label, naming words, words of the whole notice.
NOTICES = [
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license version 2 0",
     "licensed under the apache license version 2 0 you may not use this file except in compliance with the license "
     "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
     "on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "mit license", "licensed under the mit license"),
    ("mit", "deal in the software without restriction",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction"),
    ("bsd-style", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met"),
    ("gpl-notice", "gnu general public license", "licensed under the gnu general public license"),
    ("gpl-notice", "gnu general public license",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation"),
    ("lgpl-notice", "gnu lesser general public license",
     "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
     "by the free software foundation"),
    ("agpl-notice", "gnu affero general public license",
     "you can redistribute it and or modify it under the terms of the gnu affero general public license as published "
     "by the free software foundation"),
    ("mpl-2.0", "mozilla public license v 2 0",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-sa", "creative commons attribution sharealike",
     "this work is licensed under a creative commons attribution sharealike international license"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "released into the public domain",
     "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.8
#: A notice of fewer distinct words says little by its share: all of them must stand in the block.
SHORT = 12


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    threshold: float
    exact: bool
    name: tuple[str, ...] = ()

    @property
    def need(self) -> int:
        return math.ceil(self.threshold * len(set(self.words)) - 1e-9)


def notice(label: str, name: str, words: str) -> Template:
    """A notice that must name its license: the words of ``name`` stand consecutively in the matching block."""
    seq = tuple(words.split())
    return Template(label, seq, THRESHOLD if len(set(seq)) >= SHORT else 1.0, False, tuple(name.split()))


def default_templates() -> list[Template]:
    return [Template(n, tuple(p.split()), 1.0, True) for n, p in PHRASES] + [notice(*n) for n in NOTICES]


def word_counts(docs: DataFrame, templates: list[Template], text: str = "text") -> dict[str, int]:
    """Occurrences over all documents of each template word (a fixed, small vocabulary)."""
    vocabulary = sorted({w for t in templates for w in t.words + t.name})
    number = {w.encode(): i for i, w in enumerate(vocabulary)}

    def count(batches):
        total = np.zeros(len(vocabulary) + 1, np.int64)
        get = number.get
        for b in batches:
            for raw in raw_texts(b, "text"):
                total += np.bincount([get(w, len(vocabulary)) for w in ascii_words(raw)] or [len(vocabulary)],
                                     minlength=len(vocabulary) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(vocabulary)), pa.int64()), pa.array(total[:-1])],
                                         names=["w", "n"])

    rows = (map_arrow(docs.select(F.col(text).alias("text")), count, "w long, n long")
            .groupBy("w").agg(F.sum("n").alias("n")).collect())
    return {vocabulary[r["w"]]: r["n"] for r in rows}


def stands(held: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where ``words`` stand consecutively in ``held``."""
    if len(held) < len(words):
        return np.zeros(0, np.int64)
    return np.flatnonzero((np.lib.stride_tricks.sliding_window_view(held, len(words)) == words).all(axis=1))


class TemplateIndex:
    """Templates as word numbers in global frequency order, with the prefix index."""

    def __init__(self, templates: list[Template], counts: dict[str, int]):
        order = sorted({w for t in templates for w in t.words + t.name}, key=lambda w: (counts.get(w, 0), w))
        self.number = {w.encode(): i for i, w in enumerate(order)}
        self.templates = templates
        self.sequence = [np.array([self.number[w.encode()] for w in t.words]) for t in templates]
        self.names = [np.array([self.number[w.encode()] for w in t.name], np.int64) for t in templates]
        self.sets = [np.unique(s) for s in self.sequence]  # ascending number = rarest first
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(templates):
            for i, w in enumerate(self.sets[k][:len(self.sets[k]) - t.need + 1].tolist()):
                self.prefix.setdefault(w, []).append((k, i))
        self.is_prefix = np.zeros(len(order) + 1, bool)
        self.is_prefix[list(self.prefix)] = True

    def scan(self, words: list[bytes]) -> tuple[dict[int, float], dict[int, set[int]]]:
        """(best containment of each matching template, places of each phrase template)."""
        get, none = self.number.get, len(self.number)
        ids = np.array([get(w, none) for w in words], np.int64)
        first: dict[tuple[int, int], int] = {}
        for p in np.flatnonzero(self.is_prefix[ids]).tolist():
            for k, i in self.prefix[int(ids[p])]:
                step = len(self.sequence[k])
                for block in (p // step - 1, p // step):
                    if block >= 0:
                        key = (k, block)
                        first[key] = min(i, first.get(key, i))
        best: dict[int, float] = {}
        places: dict[int, set[int]] = {}
        for (k, block), i in first.items():
            t, have, step = self.templates[k], self.sets[k], len(self.sequence[k])
            if len(have) - i < t.need:  # positional filter
                continue
            held = ids[block * step:(block + 2) * step]
            distinct = np.unique(held[held < none])
            if len(distinct) < t.need:  # length filter
                continue
            overlap = len(np.intersect1d(distinct, have, assume_unique=True))
            if overlap < t.need:
                continue
            if len(self.names[k]) and not len(stands(held, self.names[k])):
                continue
            if t.exact:
                at = stands(held, self.sequence[k])
                if not len(at):
                    continue
                places.setdefault(k, set()).update(int(a) + block * step for a in at)
            best[k] = max(best.get(k, 0.0), overlap / len(have))
        return best, places


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
          T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
          T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
          T.StructField("score", T.DoubleType())]


def scan_licenses(docs: DataFrame, *, text: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """``docs`` plus n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``base_labels`` come from phrase templates, ``labels`` from all; ``score`` is the
    highest containment of a matching template.
    """
    templates = templates or default_templates()
    shared = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates, word_counts(docs, templates, text)))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]

    def make(batches):
        index = shared.value
        for b in batches:
            out = []
            for raw in raw_texts(b, text):
                words = ascii_words(raw)
                best, places = index.scan(words)
                at = [p for v in places.values() for p in v]
                name = index.templates
                out.append((len(words), len(at), min(at, default=None), max(at, default=None),
                            ",".join(sorted({name[k].label for k in places})),
                            ",".join(sorted({name[k].label for k in best})), max(best.values(), default=0.0)))
            yield [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]

    return append_columns(docs, FIELDS, make)
