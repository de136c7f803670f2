"""Operator 11: phrase collocations, counted in counting quotient filters.

Texts (A-Z lowered) are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and
tabs into words. Per language, ``f(phrase)`` counts all contiguous occurrences inside
pieces. Candidates are phrases of two or three words with ``f >= least``; their score is
``floor(1000000 * a * a / (l * r))`` of the lowest-scoring cut into a first part (l) and a
rest (r).

Counting. A word's id is its 64-bit hash; that no two words of a language share one is
checked over all words (else the next seed is taken), so ids name words without loss and
no dictionary has to reach the tasks. An n-gram is its ids packed into 128 or 192 bits.
An invertible permutation (xor rounds between the ids) spreads them evenly; the leading
bits are the quotient, all others the remainder, which is kept in full: the filter is a
lossless table. One filter covers one block of quotients::

    words u8 | quotient bits u8 | block u32 | entries u32 | large counts u32
    occupied bit of each quotient of the block | last-of-its-run bit of each entry
    remainders (leading id cut to whole bytes, then the other ids) | count u8 each | large counts u64

Each task counts its own documents and emits sorted filters; they are shuffled by
(language, block) and merged by one stable sort and a sum. Blocks are as many as the
input needs for a bounded block, so a language that holds most of the rows is spread
over all of its blocks, and a very common phrase is one entry of each task.

Passes: the first one counts words and two-word phrases; a bitmap of the frequent
two-word phrases (of a size set by their number, at most ``BITMAP_BITS`` bits, whose false
positives only cost space) lets the second one count only three-word phrases with both
halves frequent, which every candidate has.

Defined results: null text counts as empty, null language as ``und``; ids and other
columns are ignored; repeated rows count again; an empty table gives no rows. All
counts are exact; products are decimals of 38 digits (``a`` up to 10**15).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE_BYTES, bound_batches, map_arrow, pieces, raw_texts, written
from .jaccard_join import mix

#: Piece ends to line feeds, tabs to blanks, A-Z to a-z.
TABLE = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b
              for b in range(256))
#: Bytes of text behind one block of quotients.
BLOCK_BYTES = 8 << 20
#: Words, and n-grams, that a task holds before it emits its filters.
TASK_WORDS = 1 << 20
TASK_GRAMS = 3 << 20
BUFFER = 2 << 20
WINDOW = 1 << 19
BITMAP_BITS = 1 << 28
#: Word ids below this are none: 0 stands between pieces.
FIRST_ID = 2

_U = np.uint64
_ROUND = _U(0x9E3779B97F4A7C15)
_ADDED = [_U((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for step in range(6)]


# ------------------------------------------------------------------ the filter

def permute(limbs: list[np.ndarray]) -> list[np.ndarray]:
    """An invertible mixture of the ids of n-grams; the first limb depends on all of them."""
    out, w = list(limbs), len(limbs)
    for step in range(2 * w):
        out[step % w] = out[step % w] ^ mix(out[(step - 1) % w] + _ADDED[step])
    return out


def unpermute(limbs: list[np.ndarray]) -> list[np.ndarray]:
    out, w = list(limbs), len(limbs)
    for step in reversed(range(2 * w)):
        out[step % w] = out[step % w] ^ mix(out[(step - 1) % w] + _ADDED[step])
    return out


def _low_bytes(values: np.ndarray, n: int) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]


def encode_filter(limbs: list[np.ndarray], counts: np.ndarray, block: int, block_bits: int) -> bytes:
    """One filter of entries (permuted, ascending) that lie in ``block``."""
    n = len(counts)
    bits = min(block_bits + max(0, (n - 1).bit_length()), 56)
    slots = 1 << (bits - block_bits)
    if bits:
        slot = (limbs[0] >> _U(64 - bits)).astype(np.int64) - block * slots
    else:
        slot = np.zeros(n, np.int64)
    occupied = np.zeros(slots, np.uint8)
    occupied[slot] = 1
    last = np.ones(n, np.uint8)
    last[:-1] = slot[1:] != slot[:-1]
    large = counts >= 255
    head = np.array([len(limbs), bits], np.uint8).tobytes() + np.array([block, n, int(large.sum())], "<u4").tobytes()
    rest = np.concatenate([_low_bytes(limbs[0], -(-(64 - bits) // 8))] + [_low_bytes(x, 8) for x in limbs[1:]], axis=1)
    return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(last).tobytes(), rest.tobytes(),
                     np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[large].astype("<u8").tobytes()])


def decode_filter(raw: bytes, block_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(permuted ids, counts) of a filter, in its order."""
    w, bits = raw[0], raw[1]
    block, n, n_large = (int(x) for x in np.frombuffer(raw, "<u4", 3, 2))
    at, slots = 14, 1 << (bits - block_bits)

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(raw, np.uint8, size, at - size)
    occupied = np.flatnonzero(np.unpackbits(take(-(-slots // 8)), count=slots))
    last = np.unpackbits(take(-(-n // 8)), count=n)
    run = np.cumsum(last, dtype=np.int64) - last
    lead = -(-(64 - bits) // 8)
    rest = take(n * (lead + 8 * (w - 1))).reshape(n, -1)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :lead] = rest[:, :lead]
    low = wide.view("<u8").reshape(-1)
    if bits:
        quotient = (occupied[run] + block * slots).astype(np.uint64)
        low = (quotient << _U(64 - bits)) | (low & _U((1 << (64 - bits)) - 1))
    limbs = [low] + [np.ascontiguousarray(rest[:, lead + 8 * i:lead + 8 * i + 8]).view("<u8").reshape(-1)
                     for i in range(w - 1)]
    counts = take(n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", n_large, at)
    return limbs, counts


def sorted_sums(limbs: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Entries in ascending order, equal ones added up."""
    if not len(counts):
        return limbs, counts
    order = np.argsort(limbs[0], kind="stable")
    limbs = [x[order] for x in limbs]
    tied = limbs[0][1:] == limbs[0][:-1]
    if any((tied & (x[1:] != x[:-1])).any() for x in limbs[1:]):  # different n-grams share the leading id
        again = np.lexsort(limbs[::-1])
        limbs, order = [x[again] for x in limbs], order[again]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in limbs])
    first = np.flatnonzero(new)
    return [x[first] for x in limbs], np.add.reduceat(counts[order], first)


def filters(limbs: list[np.ndarray], counts: np.ndarray, block_bits: int) -> Iterator[tuple[int, bytes]]:
    """(block, filter) of n-grams given by their word ids."""
    limbs, counts = sorted_sums(permute(limbs), counts)
    if not len(counts):
        return
    block = (limbs[0] >> _U(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(counts), np.int64)
    ends = np.flatnonzero(np.diff(block, append=-1)) + 1
    for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
        yield int(block[lo]), encode_filter([x[lo:hi] for x in limbs], counts[lo:hi], int(block[lo]), block_bits)


# ------------------------------------------------------------------ counting in tasks

def pair_spots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """62-bit places of two-word phrases in the bitmap of the frequent ones."""
    return mix(a * _ROUND ^ b) >> _U(2)


class Shard:
    """The words and n-grams of one language that a task holds; n-grams are packed local numbers."""

    def __init__(self, seed: int, size: int, bitmap: np.ndarray | None):
        self.seed, self.size, self.bitmap = seed, size, bitmap
        self.clear()

    def clear(self) -> None:
        import xxhash

        digest, seed, ids, counts = xxhash.xxh64_intdigest, self.seed, [0], [0]

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = n = len(ids)
                ids.append(max(digest(word, seed), FIRST_ID))
                return n
        self.numbers, self.ids, self.seen = Numbers({b"\n": 0}), ids, np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.held, self.grams, self.counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, raw: bytes) -> Iterator[None]:
        """Count a text (pieces of many texts); yields whenever the shard may be emitted."""
        raw = raw.translate(TABLE)
        at = 0
        while at < len(raw):
            end = raw.find(b"\n", at + PIECE_BYTES) + 1 or len(raw)
            words = list(filter(None, raw[at:end].replace(b"\n", b" \n ").split(b" ")))
            # Local numbers must fit a packed n-gram, so words come in windows that overlap by size - 1.
            for lo in range(0, len(words), WINDOW):
                self._window(words[lo:lo + WINDOW + self.size - 1])
                yield
            at = end

    def _window(self, words: list[bytes]) -> None:
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.size == 2:
            seen = np.bincount(at[:WINDOW], minlength=len(self.ids))
            seen[:len(self.seen)] += self.seen
            self.seen = seen
        ok = (at[:-1] > 0) & (at[1:] > 0)
        if self.size == 3:
            ids = np.array(self.ids, np.uint64)[at]
            spot = pair_spots(ids[:-1], ids[1:]) & _U(len(self.bitmap) * 8 - 1)
            ok &= (self.bitmap[(spot >> _U(3)).astype(np.int64)] >> (spot & _U(7)).astype(np.uint8) & 1).astype(bool)
            ok = ok[:-1] & ok[1:]
        ok = np.flatnonzero(ok)
        packed = np.zeros(len(ok), np.uint64)
        for i in range(self.size):
            packed = packed << _U(64 // self.size) | at[ok + i].astype(np.uint64)
        self.waiting.append(packed)
        self.held += len(packed)
        if self.held > BUFFER:
            self.settle()

    def settle(self) -> None:
        keys, counts = np.unique(np.concatenate([*self.waiting, np.zeros(0, np.uint64)]), return_counts=True)
        self.waiting, self.held = [], 0
        (self.grams,), self.counts = sorted_sums([np.concatenate([self.grams, keys])],
                                                 np.concatenate([self.counts, counts]))

    def full(self) -> bool:
        return len(self.ids) > TASK_WORDS or len(self.counts) > TASK_GRAMS

    def rows(self, lang: str, block_bits: int) -> Iterator[pa.RecordBatch]:
        self.settle()
        ids, width = np.array(self.ids, np.uint64), 64 // self.size
        mask = _U((1 << width) - 1)
        limbs = [ids[(self.grams >> _U(width * (self.size - 1 - i)) & mask).astype(np.int64)] for i in range(self.size)]
        for block, raw in filters(limbs, self.counts, block_bits):
            yield _shard_batch([lang], block=[block], filter=[raw])
        if self.size == 2:
            words = [w for w in self.numbers if w != b"\n"]
            n = self.seen.tolist()
            for lo in range(0, len(words), 100_000):
                part = words[lo:lo + 100_000]
                at = [self.numbers[w] for w in part]
                yield _shard_batch([lang] * len(part), word=part, id=ids[at].view(np.int64), n=[n[i] for i in at])
        self.clear()


_SHARD = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("filter", pa.binary()), ("word", pa.binary()),
                    ("id", pa.int64()), ("n", pa.int64())])


def _shard_batch(lang: list[str], **given) -> pa.RecordBatch:
    n = len(lang)
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string())] + [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type)
                                         for f in list(_SHARD)[1:]], schema=_SHARD)


def count_shards(docs: DataFrame, size: int, seed: int, block_bits: int, bitmap=None) -> DataFrame:
    """Per task: filters of the ``size``-word phrases and, with ``size`` 2, the words' counts.

    ``docs(lang, text)``; ``bitmap``: a broadcast bitmap of frequent two-word phrases.
    """
    def run(batches):
        held: dict[str, Shard] = {}
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for b in pieces(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, raw in zip(b.column("lang").to_pylist(), raw_texts(b)):
                by_lang.setdefault(lang, []).append(raw)
            for lang, raws in by_lang.items():
                shard = held.setdefault(lang, Shard(seed, size, bits))
                for _ in shard.add(b"\n".join([*raws, b""])):
                    if shard.full():
                        yield from shard.rows(lang, block_bits)
        for lang, shard in held.items():
            yield from shard.rows(lang, block_bits)

    return map_arrow(docs, run, "lang string, block long, filter binary, word binary, id long, n long")


def merge_filters(shards: DataFrame, size: int, block_bits: int, least: int) -> DataFrame:
    """``lang, a, b, [c,] n, spot`` of the phrases that all shards together count at least ``least`` times."""
    names = ["a", "b", "c"][:size]

    def merge(table: pa.Table) -> pa.Table:
        parts = [decode_filter(raw, block_bits) for raw in table.column("filter").to_pylist()]
        limbs, counts = sorted_sums([np.concatenate([p[0][i] for p in parts]) for i in range(size)],
                                    np.concatenate([p[1] for p in parts]))
        kept = counts >= least
        ids = unpermute([x[kept] for x in limbs])
        lang = table.column("lang")[0].as_py()
        return pa.table([pa.array([lang] * int(kept.sum()), pa.string())]
                        + [pa.array(x.astype(np.uint64).view(np.int64)) for x in ids]
                        + [pa.array(counts[kept], pa.int64()), pa.array(pair_spots(ids[0], ids[1]).view(np.int64))],
                        names=["lang", *names, "n", "spot"])

    schema = "lang string, " + ", ".join(f"{x} long" for x in names) + ", n long, spot long"
    bound_batches(shards.sparkSession)
    return shards.filter("filter is not null").select("lang", "block", "filter").groupBy("lang", "block") \
        .applyInArrow(merge, schema)


def phrase_bitmap(pairs: DataFrame):
    """A broadcast bitmap of ``pairs.spot``: a power of two of bits, 16 a phrase, at most ``BITMAP_BITS``."""
    spark = pairs.sparkSession
    n = pairs.count()
    bits = min(max(1 << 15, 1 << math.ceil(math.log2(16 * n + 1))), BITMAP_BITS)
    place = F.col("spot").bitwiseAND(bits - 1) + 1
    got = (pairs.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
           .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect())
    whole = np.zeros(bits // 8, np.uint8)
    for r in got:
        lo = (r["bucket"] - 1) * 4096
        whole[lo:lo + 4096] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(whole.tobytes())


# ------------------------------------------------------------------ phrases

def counted_words(docs: DataFrame, block_bits: int, seeds: range = range(16)) -> tuple[DataFrame, DataFrame, int]:
    """(shards, words ``lang, id, word, n``, seed), with the first seed whose ids name words without loss."""
    for seed in seeds:
        shards = written(count_shards(docs, 2, seed, block_bits), "phrase-shards")
        words = written(shards.filter("word is not null").groupBy("lang", "word", "id").agg(F.sum("n").alias("n")),
                        "phrase-words")
        if not words.groupBy("lang", "id").count().filter("count > 1").take(1):
            return shards, words, seed
    raise RuntimeError("no seed gives every word an id of its own")


def _score(a, l, r):
    square = F.lit(1_000_000).cast("decimal(7,0)") * a.cast("decimal(15,0)") * a.cast("decimal(15,0)")
    score = F.call_function("div", square, l.cast("decimal(18,0)") * r.cast("decimal(18,0)"))
    return F.struct(score.cast("long").alias("score"), l.alias("l"), r.alias("r"))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10,
                 share: int = 50) -> DataFrame:
    """Every kept candidate: ``lang, phrase, words, a, l, r, n, score`` (not ranked).

    A candidate goes if a longer one holds its words contiguously and
    ``100 * f(longer) >= share * a``.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    block_bits = math.ceil(math.log2(max(1, size / BLOCK_BYTES)))
    shards, words, seed = counted_words(texts, block_bits)
    pairs = written(merge_filters(shards, 2, block_bits, least), "phrase-pairs")
    bitmap = phrase_bitmap(pairs)
    triples = written(merge_filters(count_shards(texts, 3, seed, block_bits, bitmap), 3, block_bits, least)
                      .drop("spot"), "phrase-triples")
    common = words.filter(F.col("n") >= least)

    def word(x: str) -> DataFrame:
        return common.select("lang", F.col("id").alias(x), F.col("word").cast("string").alias(f"w_{x}"),
                             F.col("n").alias(f"n_{x}"))

    inner = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"))))
    held = (triples.select("lang", "n", inner.alias("p")).select("lang", "n", "p.*")
            .groupBy("lang", "a", "b").agg(F.max("n").alias("longer")))
    two = (pairs.join(held, ["lang", "a", "b"], "left")
           .filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n")))
           .join(word("a"), ["lang", "a"]).join(word("b"), ["lang", "b"])
           .select("lang", F.concat_ws(" ", "w_a", "w_b").alias("phrase"), F.lit(2).alias("words"),
                   F.col("n").alias("a"), _score(F.col("n"), F.col("n_a"), F.col("n_b")).alias("s")))
    three = (triples.join(word("a"), ["lang", "a"]).join(word("b"), ["lang", "b"]).join(word("c"), ["lang", "c"])
             .join(pairs.select("lang", "a", "b", F.col("n").alias("n_ab")), ["lang", "a", "b"])
             .join(pairs.select("lang", F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("n_bc")),
                   ["lang", "b", "c"]))
    first, second = _score(F.col("n"), F.col("n_a"), F.col("n_bc")), _score(F.col("n"), F.col("n_ab"), F.col("n_c"))
    three = (three.select("lang", F.concat_ws(" ", "w_a", "w_b", "w_c").alias("phrase"), F.lit(3).alias("words"),
                          F.col("n").alias("a"), first.alias("x"), second.alias("y"))
             .withColumn("s", F.when(F.col("x.score") <= F.col("y.score"), F.col("x")).otherwise(F.col("y"))).drop("x", "y"))
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return two.unionByName(three).join(total, "lang").select(
        "lang", "phrase", "words", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n",
        "s.score")


def top_phrases(found: DataFrame, top: int = 2000, ways: int = 64) -> DataFrame:
    """Each language's first ``top`` phrases by score, count and phrase, ranked from 1.

    Two levels: the first ``top`` of each of ``ways`` hash groups of a language, then those of the language,
    so the last step sees at most ``ways * top`` rows a language.
    """
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(ways))
    some = (found.withColumn("_way", part)
            .withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_way").orderBy(*best)))
            .filter(F.col("_at") <= top).drop("_way", "_at"))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    return ranked.filter(F.col("rank") <= top)
