"""Operator 2: benchmark decontamination with a generalised suffix automaton.

The normalised test items (A-Z lowered, words of letters, digits and non-ASCII
characters) go into one suffix automaton over word ids. Training texts stream
through it: at every word the automaton knows the longest run, ending there,
that some item contains. A run of ``window`` words or more marks its words as
hit; an item shorter than ``window`` counts when it occurs whole. Words outside
the items' vocabulary cannot extend a run, so only stretches of known words
that are long enough to hold a window enter the automaton (exact).

The automaton is built on the driver from a stated test set. It is cut into
blocks of at most ``BLOCK_WORDS`` item words, so a broadcast block has a fixed
bound; the texts pass through one block after another and the hits add up, so a
test set of any size gives whole results.

Removal (``decontaminate``): a document whose hit words cover ``max_coverage`` or
more of it goes; in the others every hit span of ``max_span`` words or more is
cut out of the text, and the rest stays byte for byte.

Defined results: null or empty texts have no words and are clean; null items
and items without words match nothing; repeated items count once per
``item_id``; items with a null id hit words but are not listed; an empty
benchmark leaves all documents clean. Columns of ``docs`` stay, and columns
with the names of the results are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, ascii_words, raw_texts, written

#: Item words of one automaton.
BLOCK_WORDS = 100_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class SuffixAutomaton:
    """Suffix automaton of several word-id sequences (generalised: runs never cross items)."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: dict[int, set[int]] = {}
        self.whole: list[int] = [0]

    def _extend(self, last: int, c: int) -> int:
        """Append word ``c`` after state ``last``; the state of the longer sequence."""
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        cur = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return cur

    def _state(self, length: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        self.whole.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the runs of ``q`` that are no longer than ``p`` and ``c``."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int]) -> None:
        last = 0
        for c in words:
            last = self._extend(last, c)

    def finish(self, sequences: list[tuple[list[int], int]]) -> None:
        """Mark, for each item number, the states of its windows, or of the whole short item."""
        for words, item in sequences:
            state, run = 0, 0
            for c in words:
                state, run = self.step(state, run, c)
                if run >= self.window:
                    self.items.setdefault(self.at_window(state), set()).add(item)
            if 0 < len(words) < self.window:
                self.items.setdefault(state, set()).add(item)
                self.whole[state] = len(words)
        # The nearest state on the suffix path (itself included) that is a whole short item.
        self.short = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[s] = s if self.whole[s] else self.short[self.link[s]]

    def step(self, state: int, run: int, c: int) -> tuple[int, int]:
        """(state, longest matching run) after one more word."""
        nxt, link, length = self.next, self.link, self.length
        while state and c not in nxt[state]:
            state = link[state]
            run = length[state]
        if c in nxt[state]:
            return nxt[state][c], run + 1
        return 0, 0

    def at_window(self, state: int) -> int:
        """The state that holds the last ``window`` words of a run of at least that length."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state


class Matcher:
    """An automaton with its vocabulary and item ids; finds hit spans of word lists."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str | None] = []
        sequences = []
        auto = SuffixAutomaton(window)
        for item_id, raw in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ascii_words(raw)]
            if words:
                sequences.append((words, len(self.ids)))
                self.ids.append(item_id)
                auto.add(words)
        auto.finish(sequences)
        self.auto = auto
        self.least = min([window, *(len(w) for w, _ in sequences)]) if sequences else 0

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(disjoint ascending [start, end) word spans that are hit, item numbers)."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if not self.least or len(words) < self.least:
            return spans, items
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.least
        auto, window = self.auto, self.window
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            state, run = 0, 0
            for i, c in enumerate(ids[s:e].tolist(), s):
                state, run = auto.step(state, run, c)
                hit = 0
                if run >= window:
                    hit = run
                    items |= auto.items.get(auto.at_window(state), set())
                short = auto.short[state]
                while short:
                    if auto.whole[short] <= run:
                        hit = max(hit, auto.whole[short])
                        items |= auto.items[short]
                    short = auto.short[auto.link[short]]
                if hit:
                    lo = i + 1 - hit
                    while spans and spans[-1][1] >= lo:
                        lo = min(lo, spans.pop()[0])
                    spans.append((lo, i + 1))
        return spans, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def matchers(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", window: int = 10,
             block_words: int = BLOCK_WORDS):
    """Yield matchers of bounded size over all items; items arrive partition by partition."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.encode(F.col(text), "UTF-8").alias("t"))
    block, n = [], 0
    for r in rows.filter("t is not null").distinct().toLocalIterator():
        m = len(ascii_words(bytes(r["t"])))
        if block and n + m > block_words:
            yield Matcher(block, window)
            block, n = [], 0
        block.append((r["i"], bytes(r["t"])))
        n += m
    yield Matcher(block, window)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def match_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
                item_text: str = "text", window: int = 10, block_words: int = BLOCK_WORDS,
                removal: tuple[int, float] | None = None) -> DataFrame:
    """``docs`` plus ``n_words``, ``spans`` (hit words) and ``items`` (ids, ascending as strings).

    With ``removal`` (max_span, max_coverage) the pass over the last block also
    applies the decision: ``text`` comes out without the cut spans, and
    ``covered`` (instead of the three columns) marks documents to drop.
    """
    sc = docs.sparkSession.sparkContext
    blocks = matchers(benchmark, item_id=item_id, text=item_text, window=window, block_words=block_words)
    out, first, m = docs, True, next(blocks)
    while m is not None:
        following = next(blocks, None)
        out = _one_block(out, sc.broadcast(m), text, first, removal if following is None else None)
        if following is not None:  # one Python worker per task, however many blocks there are
            out = written(out, "decontamination-block")
        first, m = False, following
    return out


def _one_block(docs: DataFrame, shared, text: str, first: bool, removal: tuple[int, float] | None) -> DataFrame:
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS),
              T.StructField("items", T.ArrayType(T.StringType()))]
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
    if removal:
        fields = [T.StructField(text, T.StringType()), T.StructField("covered", T.BooleanType())]

    def found(b, m):
        """(text, number of words, hit spans, item ids) of each row."""
        old = None if first else list(zip(b.column("spans").to_pylist(), b.column("items").to_pylist()))
        for i, raw in enumerate(raw_texts(b, text)):
            words = ascii_words(raw)
            spans, items = m.spans(words)
            ids = {m.ids[x] for x in items if m.ids[x] is not None}
            if old is not None:
                spans = _merge([(s["start"], s["end"]) for s in old[i][0]] + spans)
                ids |= set(old[i][1])
            yield raw, len(words), spans, ids

    def report(batches):
        m = shared.value
        for b in batches:
            rows = [(n, [{"start": a, "end": z} for a, z in spans], sorted(ids)) for _, n, spans, ids in found(b, m)]
            yield [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    def remove(batches):
        m = shared.value
        max_span, max_coverage = removal
        for b in batches:
            texts, covered = [], []
            for raw, n, spans, _ in found(b, m):
                # A span shorter than a window consists of whole short items.
                cuts = [(lo, hi) for lo, hi in spans if hi - lo >= max_span or hi - lo < m.window]
                covered.append(n > 0 and sum(hi - lo for lo, hi in spans) >= max_coverage * n)
                texts.append(cut_spans(raw, cuts) if cuts else raw)
            whole = pa.array(texts, pa.binary()).cast(pa.string())
            old = b.column(text).cast(pa.string())
            yield [pc.if_else(pc.is_valid(old), whole, old), pa.array(covered, pa.bool_())]

    return append_columns(docs, fields, remove if removal else report)


def hit_words() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The report: ``docs`` plus n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    m = match_spans(docs, benchmark, **options)
    return (m.withColumn("n_hit", hit_words())
            .withColumn("n_items", F.size("items").cast("long"))
            .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
            .withColumn("contaminated", F.col("n_hit") > 0))


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``raw`` without the bytes from the first to the last word of each span."""
    at = [w.span() for w in _WORD.finditer(raw)]
    out, last = [], 0
    for lo, hi in spans:
        out.append(raw[last:at[lo][0]])
        last = at[hi - 1][1]
    return b"".join(out) + raw[last:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", max_span: int = 10,
                  max_coverage: float = 0.5, **options) -> DataFrame:
    """``docs`` with its columns: covered documents go, hit spans leave the texts of the others.

    A document is dropped when hit words are ``max_coverage`` or more of its
    words. Elsewhere each merged hit span of ``max_span`` or more words is cut, and so
    is each span shorter than a window: it holds only whole items of fewer words.
    """
    names = docs.columns
    place = {n: f"c{i}" for i, n in enumerate(names)}  # names that no column of the match clashes with
    work = docs.select(*[F.col(n).alias(c) for n, c in place.items()])
    m = match_spans(work, benchmark, text=place[text], removal=(max_span, max_coverage), **options)
    return m.filter(~F.col("covered")).select(*[F.col(c).alias(n) for n, c in place.items()])
