"""Operator 12: spelling variants, joined by asymmetric q-chunks.

Words are the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of the texts with A-Z lowered,
after ``slip``; kept are those of at least ``MIN_LETTERS`` code points with at least
``MIN_COUNT`` occurrences. Two words are near if one inserted, deleted or replaced code
point turns one into the other. A word's form is its near word of largest count, if that
is at least ``RATIO`` times its own; roots follow forms to the last.

Join. The shorter word of a pair (or the smaller of two equally long ones) contributes two
disjoint chunks, its halves; the other one all its positional grams of those lengths at the
chunks' places, shifted by at most one. One edit leaves one half whole, at its place or
shifted by the difference of the lengths, so a near pair always meets. Halves of short
words are shared by very many words, so the same rule is applied once more to what remains
beside the chunk: the remainders of a near pair are again within one edit, and one half of
the shorter remainder is whole. The join key is the hash of both chunks with length and
places; ``levenshtein`` verifies every pair that meets, so hash collisions add nothing.
No key holds more than words that agree in three quarters of their letters, and Spark
splits a key that is hot (both sides of the join are written tables).

``slip`` (fixed by the task): with h the unsigned crc32 of ``<doc_id>:<lowered run>`` in
UTF-8, a run whose h is divisible by 199 loses its code point ``h % length``.

Defined results: null texts have no words; a null id counts as empty text in h; repeated
rows count again; other columns are ignored; an empty table gives no rows. Ties between
forms go to the smallest in code-point order. Counts grow strictly along forms, so
following them ends.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pieces, raw_texts, written

MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5
SLIP_EVERY = 199
#: Distinct words that a task counts before it emits them.
TASK_WORDS = 500_000

_CONT = bytes(range(0x80, 0xC0))
#: Letters stay (A-Z lowered), as does the lead byte of U+00C0 to U+00FF; other ASCII becomes blanks.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PLAIN = bytes(range(128)) + b"\xc3" + _CONT
_OTHER = re.compile(rb"[\xc2\xc4-\xf7][\x80-\xbf]*")


def runs(raw: bytes) -> list[bytes]:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a UTF-8 text, A-Z lowered."""
    if raw.translate(None, _PLAIN):  # characters beyond U+00FF, or U+0080 to U+00BF
        raw = _OTHER.sub(b" ", raw)
    return raw.translate(_LETTERS).split()


def slip(run: bytes, h: int) -> bytes:
    """``run`` without its code point ``h % length`` where ``SLIP_EVERY`` divides ``h``."""
    if h % SLIP_EVERY:
        return run
    s = run.decode()
    at = h % len(s)
    return (s[:at] + s[at + 1:]).encode()


def count_words(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, n`` of all words of at least ``MIN_LETTERS`` code points, whatever their count."""
    def run(batches):
        total: Counter[bytes] = Counter()

        def flush():
            kept = [(w, n) for w, n in total.items() if len(w) - w.count(b"\xc3") >= MIN_LETTERS]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()),
                                               pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])
        for b in pieces(batches):
            for d, raw in zip(b.column("doc_id").to_pylist(), raw_texts(b)):
                start = zlib.crc32(b"%s:" % (b"" if d is None else str(d).encode()))
                for w, n in Counter([r for r in runs(raw) if len(r) >= MIN_LETTERS]).items():
                    total[slip(w, zlib.crc32(w, start))] += n
                if len(total) > TASK_WORDS:
                    yield flush()
        yield flush()

    rows = map_arrow(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")), run,
                     "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).select(F.col("word").cast("string").alias("word"), "n")


def halves(length: int) -> list[tuple[int, int]]:
    """(place, length) of the two disjoint chunks of a text."""
    return [(0, length // 2), (length // 2, length - length // 2)]


def chunk_keys(word: str) -> set[tuple]:
    """The four keys of a word on the chunk side: each half, with each half of what remains."""
    n = len(word)
    return {(n, c, e, word[c:c + q], (word[:c] + word[c + q:])[e:e + p])
            for c, q in halves(n) for e, p in halves(n - q)}


def gram_keys(word: str) -> set[tuple]:
    """The keys of a word on the gram side: positional grams for shorter words of its length or one less."""
    n, out = len(word), set()
    for m in (n, n - 1):
        for c, q in halves(m):
            for at in range(c, c + n - m + 1):
                gram, rest = word[at:at + q], word[:at] + word[at + q:]
                out |= {(m, c, e, gram, rest[x:x + p]) for e, p in halves(m - q) for x in range(e, e + n - m + 1)}
    return out


def _keyed(words: DataFrame, make, name: str) -> DataFrame:
    def run(batches):
        import xxhash

        for b in batches:
            for at in range(0, b.num_rows, 5_000):
                part = b.slice(at, 5_000)
                keys = [[xxhash.xxh3_64_intdigest("%d,%d,%d,%s\0%s" % k) for k in make(w)]
                        for w in part.column("word").to_pylist()]
                take = pa.array([i for i, ks in enumerate(keys) for _ in ks], pa.int64())
                flat = pa.array([k - (1 << 63) for ks in keys for k in ks], pa.int64())
                yield pa.RecordBatch.from_arrays([flat, part.column("word").take(take), part.column("n").take(take)],
                                                 names=["key", name, f"n_{name}"])

    return map_arrow(words.select("word", "n"), run, f"key long, {name} string, n_{name} long")


def near_pairs(words: DataFrame) -> DataFrame:
    """``x, n_x, y, n_y``: every pair of ``words(word, n)`` one edit apart, once, the shorter (smaller) first."""
    chunks = written(_keyed(words, chunk_keys, "x"), "spelling-chunks")
    grams = written(_keyed(words, gram_keys, "y"), "spelling-grams")
    met = chunks.join(grams, "key").filter(
        ((F.char_length("x") < F.char_length("y")) | (F.col("x") < F.col("y")))
        & (F.levenshtein("x", "y", 1) == 1))
    return met.select("x", "n_x", "y", "n_y").distinct()


def spelling_forms(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word."""
    words = written(count_words(docs, text=text, doc_id=doc_id).filter(F.col("n") >= MIN_COUNT), "spelling-words")
    pairs = written(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("other"), F.col("n_y").alias("m")).union(
        pairs.select("y", "x", "n_x"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other"))
                                    .alias("best"))
    strong = -F.col("best.m") >= RATIO * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"))
    return follow(written(forms, "spelling-forms"))


def follow(forms: DataFrame) -> DataFrame:
    """``forms`` plus ``root``: every round jumps twice as far, until no word moves."""
    links = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        links = written(links, "spelling-roots")
        step = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not links.join(step, "root", "left_semi").take(1):
            break
        links = links.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
