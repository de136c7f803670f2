"""Operator 6: n-gram Jaccard join with signature trees.

A document's set holds the hashes of its distinct ``k``-word shingles (words split
at white space, A-Z lowered; a text of fewer words is one shingle). Two documents
link when ``100 * |A & B| >= percent * |A | B|``. The result names the connected
component of every document.

Candidates come from keys that lose no link, by one of two ways.

**Parts** (from 90 percent on). If the smaller of two linked sets has ``a`` shingles, at
most ``a * (100 - percent) / percent`` differ. Sets are cut by hash into more parts than
can differ, so linked sets agree in a whole part, and its hash is a key both have. The
number of parts depends on a size class; a set uses the classes of all larger sets that
may link with it too. Parts of fewer than ``STRONG`` shingles say little, so they are left
out as long as fewer parts are weak than must agree; otherwise the set also uses a
second (third, ...) way of cutting. Sets that share keys form candidate clusters, and
signature trees decide inside them (``links_within_clusters``).

**Rare shingles** (below).

1. Keys that lose no link. If A and B link, they share at least ``percent`` / 100 of
   the shingles of either, so in any order of all shingles that is the same for every
   set, the first ``n - ceil(n * percent / 100) + 1`` shingles of A and those of B have
   one in common: these are a set's keys. The order puts rare shingles first, by a
   sketch of ``SLOTS`` counters over the shingles of all documents, so passages that
   very many documents share make no keys unless a document holds little else. The
   sketch has a fixed size and decides only how many candidates there are.
2. The sets that share a key are a group; groups with the same members count once
   (all shingles of a passage give one group). A set carries a signature: a bitmap
   of its shingles, as long as the set asks for.
3. First come ``STAR_TURNS`` turns of stars: every set meets one set of each of its
   groups (the smallest; then, of what is not joined yet, one of each component meets
   another member). Pairs whose greatest possible overlap by signatures and sizes is
   too small drop out, the others are counted exactly. That joins nearly all of a group
   of near copies, however large, with a few comparisons a set.
4. Then only groups whose members are still in several components are searched with
   signature trees: nodes hold the OR of their members' bitmaps and the range of their
   sizes; dual traversal drops node pairs whose greatest possible overlap is too small
   and pairs whose members are in one component. It runs on signatures alone first,
   which leaves the members that may link at all, as edges that connect them. A pair
   meets in many groups (one of each rare shingle both have), so the groups are left
   behind here: sets connected by those edges form clusters, and every set travels once,
   to its cluster, where pairs are counted exactly and only links that join components
   are emitted. Very large groups and clusters are cut into blocks, and pairs of blocks
   are bounded tasks.

Sets are 64-bit hashes, and sets are named by 64-bit hashes: with n different
shingles or sets about n * n / 2**65 collide by chance.

Defined results: null and empty texts have no shingles and are their own
component, as are null ids; equal texts link; repeated ``doc_id`` rows are
separate documents with the same name; the component is named by its smallest
non-null ``doc_id``. Columns of ``docs`` other than id and text are ignored by
``components_by_jaccard``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_arrow, pieces, raw_texts, sized_broadcast, space_words, unused_name, written

#: Shingles that make a part of a set worth a key, and ways of cutting a set before weak parts are used.
STRONG = 2
WAYS = 6
GROWTH = 1.25
#: Counters of the sketch that orders shingles; rows of it that tasks exchange.
SLOTS = 1 << 18
SLOT_BLOCKS = 64
#: Sets and shingles of one block of a cluster.
BLOCK_SETS = 2_000
BLOCK_SHINGLES = 2_000_000
#: Turns in which groups are joined by stars, before they are searched.
STAR_TURNS = 3
#: Bytes of shared keys that are broadcast: they pass through the driver, and there are several to a set.
KEY_BROADCAST = 8 << 20
LEAF = 16

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_TURN = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB),
         np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Hash of each run of ``k`` words in order; fewer words are one run, none are no run."""
    return run_hashes(word_hashes(words), k)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """``shingle_hashes`` from the words' hashes."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        return mix(sum((mix(h[i:i + 1] + np.uint64(n)) * _TURN[i % 5] for i in range(n)), np.zeros(1, np.uint64)))
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total = total * _M1 + h[i:n - k + 1 + i]
    return mix(total)


def slots_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def prefix_keys(s: np.ndarray, weights: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set (ascending, distinct) in the order of the sketch's counts, ties by hash."""
    n = len(s)
    first = n - -(-n * percent // 100) + 1
    return s[np.lexsort((s, weights[slots_of(s)]))[:first]] if n else s


def shingle_weights(docs: DataFrame, k: int):
    """A broadcast array: how many sets of ``docs(text)`` hold a shingle of each slot.

    One row per task and block of slots is exchanged; a block's task adds them up as
    they come, so it holds ``SLOTS / SLOT_BLOCKS`` counters however many there are.
    """
    size = SLOTS // SLOT_BLOCKS

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in pieces(batches):
            held = [slots_of(np.unique(shingle_hashes(space_words(raw), k))) for raw in raw_texts(b, "text")]
            total += np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLOT_BLOCKS), pa.int64()), pa.array([x.tobytes() for x in total.reshape(-1, size)], pa.binary())],
            names=["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()),
                                          pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    schema = "block long, counts binary"
    rows = map_arrow(map_arrow(docs.select("text"), count, schema).repartition("block"), add, schema).collect()
    whole = np.zeros((SLOT_BLOCKS, size), np.int64)
    for r in rows:
        whole[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return docs.sparkSession.sparkContext.broadcast(whole.reshape(-1))


class Parts:
    """The part keys of sets, for a threshold of ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.classes: list[tuple[int, int, int, int]] = []  # first size, last size, parts, spare
        lo = math.ceil(percent / (100 - percent)) if percent < 100 else 1 << 62
        self.least = lo

    def size_class(self, c: int) -> tuple[int, int, int, int]:
        while len(self.classes) <= c:
            lo = self.classes[-1][1] + 1 if self.classes else self.least
            hi = max(lo, int(lo * GROWTH))
            differ = hi * (100 - self.percent) // self.percent
            parts, spare = differ + 1, 0
            for k in range(differ + 1, 2 * differ + 9):
                m = lo * self.percent / 100 / k
                weak = k * sum(math.exp(-m) * m ** i / math.factorial(i) for i in range(STRONG))
                if k - differ - 1 >= weak + 2 * math.sqrt(weak):
                    parts, spare = k, k - differ - 1
                    break
            self.classes.append((lo, hi, parts, spare))
        return self.classes[c]

    def keys(self, s: np.ndarray) -> np.ndarray:
        n, c = len(s), 0
        if n < self.least:
            return np.zeros(0, np.uint64)
        while self.size_class(c)[1] < n:
            c += 1
        out = [self._class_keys(s, c)]
        while self.size_class(c + 1)[0] <= n * 100 // self.percent:  # classes of larger sets that may link
            c += 1
            out.append(self._class_keys(s, c))
        return np.concatenate(out)

    def _class_keys(self, s: np.ndarray, c: int) -> np.ndarray:
        _, _, parts, spare = self.size_class(c)
        found = []
        for way in range(WAYS):
            turned = mix(s + np.uint64((way + 1) * int(_M1) & 0xFFFFFFFFFFFFFFFF))
            part = ((turned >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            count = np.bincount(part, minlength=parts)
            order = np.argsort(part, kind="stable")
            sums = np.zeros(parts, np.uint64)
            full = np.flatnonzero(count)
            sums[full] = np.add.reduceat(mix(turned[order]), (np.cumsum(count) - count)[full])
            key = mix(sums + (np.arange(parts, dtype=np.uint64) * np.uint64(977) + np.uint64(c)) * _M1
                      + count.astype(np.uint64) * _M3 + np.uint64(way))
            weak = count < STRONG
            if weak.sum() <= spare:
                found.append(key[~weak])
                break
            found.append(key if way == WAYS - 1 else key[~weak])
        return np.concatenate(found)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


class Node:
    __slots__ = ("lo", "hi", "bits", "small", "large", "excess", "parts", "whole")


class SignatureTree:
    """A tree over ``sets`` (sorted hash arrays), whose members are ``first .. first + len(sets)``."""

    def __init__(self, sets: list[np.ndarray], first: int, n_bits: int):
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]) if len(sets[i]) else 0))
        self.members = [first + i for i in order]
        self.sets = [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.bits = np.zeros((len(sets), n_bits // 64), np.uint64)
        for row, s in zip(self.bits, self.sets):
            b = (s >> np.uint64(20)) & np.uint64(n_bits - 1)
            np.bitwise_or.at(row, (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        self.spare = self.sizes - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        self.root = self._build(0, len(sets)) if sets else None

    def _build(self, lo: int, hi: int) -> Node:
        n = Node()
        n.lo, n.hi, n.whole, n.parts = lo, hi, False, []
        if hi - lo > LEAF:
            step = max(LEAF, -(-(hi - lo) // 4))
            n.parts = [self._build(a, min(a + step, hi)) for a in range(lo, hi, step)]
            n.bits = np.bitwise_or.reduce([p.bits for p in n.parts])
        else:
            n.bits = np.bitwise_or.reduce(self.bits[lo:hi])
        n.small, n.large = int(self.sizes[lo]), int(self.sizes[hi - 1])
        n.excess = int(self.spare[lo:hi].max())
        return n


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two ascending arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class DualJoin:
    """Finds links between the members of two trees (or of one with itself), up to connectivity."""

    def __init__(self, percent: int, forest: Forest):
        self.percent, self.forest = percent, forest
        self.links: list[tuple[int, int]] = []

    def _one(self, tree: SignatureTree, n: Node) -> int | None:
        """The component of all members of a node, if it is only one."""
        find, m = self.forest.find, tree.members
        root = find(m[n.lo])
        if n.whole:
            return root
        if n.parts:
            same = all(self._one(tree, p) == root for p in n.parts)
        else:
            same = all(find(m[i]) == root for i in range(n.lo + 1, n.hi))
        n.whole = same
        return root if same else None

    def run(self, ta: SignatureTree, tb: SignatureTree) -> None:
        if ta.root is None or tb.root is None:
            return
        stack = [(ta.root, tb.root)]
        p = self.percent
        while stack:
            a, b = stack.pop()
            if ta is tb and a is b:
                if self._one(ta, a) is not None:
                    continue
                if a.parts:
                    k = len(a.parts)
                    stack += [(a.parts[i], a.parts[j]) for i in range(k) for j in range(i + 1, k)]
                    stack += [(x, x) for x in a.parts]  # taken first
                else:
                    self._leaves(ta, a, tb, b)
                continue
            if 100 * min(a.large, b.large) < p * max(a.small, b.small):
                continue
            most = int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.excess, b.excess)
            if most * (100 + p) < p * (a.small + b.small):
                continue
            one = self._one(ta, a)
            if one is not None and one == self._one(tb, b):
                continue
            if not a.parts and not b.parts:
                self._leaves(ta, a, tb, b)
            elif a.parts and (not b.parts or a.hi - a.lo >= b.hi - b.lo):
                stack += [(x, b) for x in a.parts]
            else:
                stack += [(a, x) for x in b.parts]

    def _leaves(self, ta: SignatureTree, a: Node, tb: SignatureTree, b: Node) -> None:
        p, find = self.percent, self.forest.find
        may = may_link(ta.sizes[a.lo:a.hi, None], ta.bits[a.lo:a.hi, None, :], ta.spare[a.lo:a.hi, None],
                       tb.sizes[None, b.lo:b.hi], tb.bits[None, b.lo:b.hi, :], tb.spare[None, b.lo:b.hi], p)
        for i, j in zip(*(x.tolist() for x in np.nonzero(may))):
            if ta is tb and a is b and i >= j:
                continue
            i, j = a.lo + i, b.lo + j
            x, y = ta.members[i], tb.members[j]
            if find(x) == find(y):
                continue
            both = overlap(ta.sets[i], tb.sets[j])
            if 100 * both >= p * (len(ta.sets[i]) + len(tb.sets[j]) - both):
                self.forest.join(x, y)
                self.links.append((x, y))


def bitmap(s: np.ndarray) -> bytes:
    """The signature of a set: a power of two of bits, about two a member."""
    n_bits = min(max(256, 1 << (2 * len(s)).bit_length()), 1 << 16)
    bits = np.zeros(n_bits, np.uint8)
    bits[((s >> np.uint64(20)) & np.uint64(n_bits - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) as they would be with fewer bits."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class BitmapTree(SignatureTree):
    """A tree over signatures and sizes alone."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, bits: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.members, self.sizes, self.bits = members[order].tolist(), sizes[order], bits[order]
        self.spare = self.sizes - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        self.root = self._build(0, len(order)) if len(order) else None


class MemberSearch(DualJoin):
    """Finds the members that may link with one of another component by signatures and sizes.

    ``links`` are pairs of them that connect whatever may link.
    """

    def __init__(self, percent: int, forest: Forest):
        super().__init__(percent, forest)
        self.near = Forest(len(forest.up))

    def _leaves(self, ta: SignatureTree, a: Node, tb: SignatureTree, b: Node) -> None:
        p, find = self.percent, self.forest.find
        may = may_link(ta.sizes[a.lo:a.hi, None], ta.bits[a.lo:a.hi, None, :], ta.spare[a.lo:a.hi, None],
                       tb.sizes[None, b.lo:b.hi], tb.bits[None, b.lo:b.hi, :], tb.spare[None, b.lo:b.hi], p)
        for i, j in zip(*(x.tolist() for x in np.nonzero(may))):
            if not (ta is tb and a is b and i >= j):
                x, y = ta.members[a.lo + i], tb.members[b.lo + j]
                if find(x) != find(y) and self.near.find(x) != self.near.find(y):
                    self.near.join(x, y)
                    self.links.append((x, y))


def may_link(na, bits_a, spare_a, nb, bits_b, spare_b, percent: int) -> np.ndarray:
    """Whether sets may reach the threshold: common bits, and members beyond a set's bits, bound their overlap."""
    common = np.bitwise_count(bits_a & bits_b).sum(axis=-1).astype(np.int64)
    most = np.minimum(common + np.minimum(spare_a, spare_b), np.minimum(na, nb))
    return most * (100 + percent) >= percent * (na + nb)


def possible_pairs(rows: list[tuple[int, int, bytes, int, int]], percent: int) -> list[tuple[int, int]]:
    """Pairs of places in ``rows`` (id, size, signature, component, side) that connect all that may link; with two sides, across them."""
    forest, first = Forest(len(rows)), {}
    for i, r in enumerate(rows):
        forest.join(i, first.setdefault(r[3], i))
    search = MemberSearch(percent, forest)
    sizes = np.array([r[1] for r in rows], np.int64)

    def classes(side: int) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            if r[4] == side:
                out.setdefault(len(r[2]) // 8, []).append(i)
        return out

    def tree(at: list[int], words: int) -> BitmapTree:
        bits = folded(np.frombuffer(b"".join(rows[i][2] for i in at), np.uint64).reshape(len(at), -1), words)
        return BitmapTree(np.array(at), sizes[at], bits)
    left = classes(0)
    right = classes(1)
    for wa, a in left.items():
        for wb, b in (right or left).items():
            if not right and wa == wb:
                whole = tree(a, wa)
                search.run(whole, whole)
            elif right or wa < wb:
                words = min(wa, wb)
                search.run(tree(a, words), tree(b, words))
    return search.links


def possible_members(rows: list[tuple[int, int, bytes, int, int]], percent: int) -> list[int]:
    """The places in ``rows`` that may link."""
    return sorted({i for pair in possible_pairs(rows, percent) for i in pair})


def block_links(rows: list[tuple[int, np.ndarray, int, int]], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among ``rows`` of (id, set, component, side), given the components so far.

    With rows of both sides, only pairs of side 0 with side 1.
    """
    n_bits = 256
    while n_bits < min(1 << 16, 2 * max(len(r[1]) for r in rows)):
        n_bits *= 2
    forest = Forest(len(rows))
    join = DualJoin(percent, forest)
    first: dict[int, int] = {}
    for i, r in enumerate(rows):
        forest.join(i, first.setdefault(r[2], i))
    left = [i for i, r in enumerate(rows) if r[3] == 0]
    right = [i for i, r in enumerate(rows) if r[3] == 1]
    ta = SignatureTree([rows[i][1] for i in left], 0, n_bits)
    ta.members = [left[m] for m in ta.members]
    tb = ta
    if right:
        tb = SignatureTree([rows[i][1] for i in right], 0, n_bits)
        tb.members = [right[m] for m in tb.members]
    join.run(ta, tb)
    return [(rows[a][0], rows[b][0]) for a, b in join.links]


def _grouped(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams sorted rows (g, id, component, side, hashes) and joins each group ``g``."""
    def run(batches):
        now, rows, last = None, [], None
        for batch in pieces(batches):
            cols = [batch.column(c) for c in ("g", "id", "component", "side", "hashes")]
            for g, i, comp, side, raw in zip(*(c.to_pylist() for c in cols)):
                if g != now:
                    if len(rows) > 1:
                        yield _pairs(block_links(rows, percent))
                    now, rows, last = g, [], None
                if (i, side) != last:  # a row that is there twice counts once
                    rows.append((i, np.frombuffer(raw, np.uint64), comp, side))
                    last = (i, side)
        yield _pairs(block_links(rows, percent) if len(rows) > 1 else [])
    return run


def _joined(rows: DataFrame, percent: int) -> DataFrame:
    grouped = rows.select("g", "id", "component", "side", "hashes").repartition("g").sortWithinPartitions("g", "side", "id")
    return map_arrow(grouped, _grouped(percent), "a long, b long")


def links_within_clusters(sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links ``(a, b)`` that connect all linked sets of ``sets(cluster, id, n, hashes)``.

    ``hashes`` is the ascending array of distinct 64-bit hashes as bytes. The
    result connects exactly what the threshold links inside each cluster; with a column
    ``component`` (the smallest id of what is joined already), together with that.
    """
    if "component" not in sets.columns:
        sets = sets.withColumn("component", F.col("id"))
    sets = written(sets, f"{kind}-sets")
    # One row per cluster that needs more than one block.
    big = (sets.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
           .withColumn("blocks", F.ceil(F.greatest(F.col("c") / BLOCK_SETS, F.col("s") / BLOCK_SHINGLES)).cast("long"))
           .filter("blocks > 1").select("cluster", "blocks"))
    big = written(big, f"{kind}-big")
    blocked = (sets.join(big, "cluster", "left")
               .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
               .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))))

    first = blocked.select(F.concat_ws(":", "cluster", "block").alias("g"), "id", "component",
                           F.lit(0).cast("long").alias("side"), "hashes")
    links = written(_joined(first, percent), f"{kind}-links")
    if not big.take(1):
        return links
    # Clusters of several blocks: sets outside the largest component of the cluster meet the other blocks.
    known = sets.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    parts = components(links.union(known), f"{kind}-cc")
    named = (blocked.drop("component").filter("blocks > 1").join(parts.withColumnRenamed("root", "component"), "id", "left")
             .withColumn("component", F.coalesce("component", "id")))
    named = written(named.select("cluster", "id", "component", "blocks", "block", "hashes"), f"{kind}-named")
    main = (named.groupBy("cluster", "component").count().groupBy("cluster")
            .agg(F.max(F.struct("count", "component")).alias("m")).select("cluster", F.col("m.component").alias("main")))
    rest = named.join(main, "cluster").filter("component <> main")
    size = (rest.groupBy("cluster").agg(F.count("*").alias("c"), F.sum(F.length("hashes") / 8).alias("s"))
            .withColumn("rests", F.ceil(F.greatest(F.col("c") / BLOCK_SETS, F.col("s") / BLOCK_SHINGLES)).cast("long"))
            .select("cluster", "rests"))
    size = written(size, f"{kind}-rest")
    if not size.take(1):
        return links
    small = (rest.join(size, "cluster").withColumn("mine", F.pmod(F.xxhash64(F.lit("rest"), "id"), F.col("rests")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("cluster", "mine", "other", "id", "component", F.lit(0).cast("long").alias("side"), "hashes"))
    full = (named.join(size, "cluster")
            .withColumn("mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)))
            .select("cluster", "mine", F.col("block").alias("other"), "id", "component",
                    F.lit(1).cast("long").alias("side"), "hashes"))
    both = small.unionByName(full).withColumn("g", F.concat_ws(":", "cluster", "mine", "other"))
    return written(links.union(_joined(both, percent)), f"{kind}-all-links")


def candidate_clusters(keyed: DataFrame, kind: str) -> DataFrame:
    """``(id, root)`` of ids that share a key with another id; ``keyed(id, key)`` may repeat rows.

    Per key only the smallest and largest id are aggregated (map-side combined,
    so copies collapse before the shuffle); keys with one id drop out, and the
    ids of the others are chained to the smallest.
    """
    shared = written(keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
                     .filter("low < high").select("key", "low"), f"{kind}-keys")
    hot = sized_broadcast(shared, shared.count(), 16, 64 << 20)
    edges = keyed.join(hot, "key").filter("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    return components(edges, f"{kind}-candidates")


def shingle_sets(docs: DataFrame, k: int, percent: int, weights=None) -> DataFrame:
    """Per document ``(doc_id, n, id)``, and its signature and keys in the order of ``weights``; without them, the set itself."""
    def run(batches):
        import xxhash

        hashes, ranks = weights is None, None if weights is None else weights.value
        for b in pieces(batches):
            n, ids, bits, more = [], [], [], []
            for raw in raw_texts(b, "text"):
                s = np.unique(shingle_hashes(space_words(raw), k))
                n.append(len(s))
                ids.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))) if len(s) else None)
                if hashes:
                    more.append(s.tobytes())
                else:
                    bits.append(bitmap(s))
                    more.append(prefix_keys(s, ranks, percent).view(np.int64))
            last = [pa.array(more, pa.binary())] if hashes else [pa.array(bits, pa.binary()), pa.array(more, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), *last],
                                             names=["doc_id", "n", "id", *(["hashes"] if hashes else ["bits", "keys"])])

    last = "hashes binary" if weights is None else "bits binary, keys array<long>"
    return map_arrow(docs, run, f"doc_id long, n long, id long, {last}")


def part_keys(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per document ``(doc_id, n, id)`` and its part keys."""
    def run(batches):
        import xxhash

        parts = Parts(percent)
        for b in pieces(batches):
            sets = [np.unique(shingle_hashes(space_words(raw), k)) for raw in raw_texts(b, "text")]
            ids = [int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()),
                 pa.array([parts.keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "id", "keys"])

    return map_arrow(docs, run, "doc_id long, n long, id long, keys array<long>")


def key_groups(signed: DataFrame) -> DataFrame:
    """``(key, id, low)``: the members of every group of two or more sets that share a key, and its smallest id.

    Of groups with the same members one stays.
    """
    keyed = signed.select("id", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
                     .filter("low < high").select("key", "low"), "jaccard-keys")
    some = sized_broadcast(shared, shared.count(), 16, KEY_BROADCAST)
    members = written(keyed.join(some, "key").select("key", "id", "low").distinct(), "jaccard-members")
    sums = [F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(2)]
    one = (members.groupBy("key").agg(F.count("*").alias("c"), *sums).groupBy("c", "s0", "s1")
           .agg(F.min("key").alias("key")).select("key"))
    return written(members.join(written(one, "jaccard-groups"), "key"), "jaccard-group-members")


def possible_stars(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``pairs(a, b)`` that may link by ``signatures(id, n, bits)``."""
    def run(batches):
        for batch in pieces(batches):
            got = [batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "bits_a", "bits_b")]
            kept = []
            for a, b, na, nb, x, y in zip(*got):
                words = min(len(x), len(y)) // 8
                x, y = (folded(np.frombuffer(v, np.uint64)[None, :], words)[0] for v in (x, y))
                spare = [n - int(np.bitwise_count(v).sum()) for n, v in ((na, x), (nb, y))]
                if may_link(na, x, spare[0], nb, y, spare[1], percent):
                    kept.append((a, b))
            yield _pairs(kept)

    side = [signatures.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab"]
    return map_arrow(pairs.join(side[0], "a").join(side[1], "b"), run, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()),
                                       pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def stars(placed: DataFrame, turn: int) -> DataFrame:
    """``a, b``: in every group of ``placed(key, id, component)`` one member, another at every turn, with one of each other component."""
    by = [F.xxhash64("id", F.lit(2 * turn + i)) for i in range(2)]
    centre = placed.groupBy("key").agg(F.min_by(F.struct("id", "component"), by[0]).alias("c"))
    ends = placed.groupBy("key", "component").agg(F.min_by("id", by[1]).alias("b"))
    return (ends.join(centre, "key").filter(F.col("component") != F.col("c.component"))
            .select(F.col("c.id").alias("a"), "b").distinct())


def group_links(base: DataFrame, sets: DataFrame, placed: DataFrame, signatures: DataFrame, k: int, percent: int) -> DataFrame:
    """Links that connect what is linked in the groups of ``placed(key, id, component)``; large groups by pairs of blocks.

    Trees of signatures find the members that may link at all; only their sets are read and counted,
    once in the cluster of what may link, in however many groups they meet.
    """
    def run(batches):
        now, rows, last = None, [], None

        def may():
            return _pairs([(rows[i][0], rows[j][0]) for i, j in (possible_pairs(rows, percent) if len(rows) > 1 else [])])
        for batch in pieces(batches):
            cols = [batch.column(c).to_pylist() for c in ("g", "id", "n", "bits", "component", "side")]
            for g, i, n, bits, comp, side in zip(*cols):
                if g != now:
                    yield may()
                    now, rows, last = g, [], None
                if (i, side) != last:
                    rows.append((i, n, bits, comp, side))
                    last = (i, side)
        yield may()

    large = written(placed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("long").alias("blocks")).filter("blocks > 1"),
                    "jaccard-large")
    cut = (placed.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
           .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
           .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    side = (F.col("block") > F.col("other")).cast("long")
    rows = cut.select(F.concat_ws(":", "key", F.least("block", "other"), F.greatest("block", "other")).alias("g"), "id",
                      "component", side.alias("side"))
    signed = rows.join(signatures, "id").select("g", "id", "n", "bits", "component", "side")
    found = written(map_arrow(signed.repartition("g").sortWithinPartitions("g", "side", "id"), run, "a long, b long"), "jaccard-may")
    clusters = written(components(found, "jaccard-may-cc"), "jaccard-open-clusters")
    whole = whole_sets(base, sets, clusters.select("id"), k, percent, "jaccard-open")
    members = (whole.join(clusters.select("id", F.col("root").alias("cluster")), "id")
               .join(placed.select("id", "component").distinct(), "id")
               .withColumn("n", F.expr("length(hashes) div 8")))
    return links_within_clusters(members.select("cluster", "id", "component", "n", "hashes"), percent, "jaccard-open")


def whole_sets(base: DataFrame, sets: DataFrame, ids: DataFrame, k: int, percent: int, kind: str) -> DataFrame:
    """``id, hashes`` of the sets named by ``ids(id)``, each from one document (``sets(id, low)``)."""
    chosen = written(ids.join(sets.select("id", "low"), "id"), f"{kind}-chosen")
    n = chosen.count()
    wanted = sized_broadcast(chosen.select("low"), n, 8, 64 << 20)
    texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("low")), "left_semi")
    return written(shingle_sets(texts, k, percent).select("id", "hashes")
                   .join(sized_broadcast(chosen.select("id"), n, 8, 64 << 20), "id", "left_semi"), f"{kind}-sets")


def counted_links(base: DataFrame, sets: DataFrame, pairs: DataFrame, k: int, percent: int, kind: str) -> DataFrame:
    """The pairs of ``pairs(a, b)`` that reach the threshold, counted exactly.

    The sets come from one document each (``sets(id, low)``). A set ``a`` stands first in
    its group and its partners pass by it; one with very many partners has several groups.
    """
    def run(batches):
        own = None
        for batch in pieces(batches):
            found = []
            for a, side, i, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "side", "id", "hashes"))):
                s = np.frombuffer(raw, np.uint64)
                if side == 0:
                    own = s
                else:
                    both = overlap(own, s)
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        found.append((a, i))
            yield _pairs(found)

    pairs = written(pairs, f"{kind}-pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    whole = whole_sets(base, sets, ids, k, percent, kind)
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("long").alias("shares"))
    own = (shares.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
           .select("a", "share", F.lit(0).alias("side"), F.col("a").alias("id")))
    others = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"), F.lit(1).alias("side"),
                                            F.col("b").alias("id"))
    rows = own.union(others).join(whole, "id").repartition("a", "share").sortWithinPartitions("a", "share", "side", "id")
    return map_arrow(rows.select("a", "side", "id", "hashes"), run, "a long, b long")


def _roots_by_parts(base: DataFrame, signed: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Components of sets that share part keys: the sets of a cluster travel once and trees count them."""
    keyed = signed.select("id", F.explode("keys").alias("key"))
    clusters = written(candidate_clusters(keyed, "jaccard"), "jaccard-clusters")
    whole = whole_sets(base, sets, clusters.select("id"), k, percent, "jaccard")
    members = whole.join(clusters.select("id", F.col("root").alias("cluster")), "id").join(sets.select("id", "n"), "id")
    return components(links_within_clusters(members.select("cluster", "id", "n", "hashes"), percent, "jaccard"), "jaccard-cc")


def _roots_by_rare_shingles(base: DataFrame, signed: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Components of sets that share rare shingles: turns of stars, then the groups that are still open."""
    groups = key_groups(signed)
    ids = groups.select("id").distinct()
    signatures = written(signed.select("id", "n", "bits").join(ids, "id", "left_semi").dropDuplicates(["id"]), "jaccard-signatures")
    placed = groups.select("key", "id", F.col("id").alias("component"))
    pairs = groups.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    known = None
    for turn in range(STAR_TURNS):
        links = counted_links(base, sets, possible_stars(pairs if turn == 0 else stars(placed, turn), signatures, percent), k, percent,
                              f"jaccard-star-{turn}")
        if known is not None:  # what the turns before joined, by a link of each member with its root
            links = links.union(known.select(F.col("id").alias("a"), F.col("root").alias("b")))
        known = written(components(links, "jaccard-star-cc"), "jaccard-known")
        placed = placed.select("key", "id").join(known, "id", "left").select("key", "id", F.coalesce("root", "id").alias("component"))
        ends = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
        placed = written(placed.join(ends.filter("x < y").select("key"), "key"), "jaccard-placed")
        if not placed.take(1):  # the members of every group are in one component
            return known
    links = known.select(F.col("id").alias("a"), F.col("root").alias("b"))
    return components(links.union(group_links(base, sets, placed, signatures, k, percent)), "jaccard-cc")


def components_by_jaccard(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", k: int = 3,
                          percent: int = 90, keys: str | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    ``keys``: how candidates are found, ``parts`` or ``rare``; the result is the same.
    Parts are few where little may differ; at lower thresholds they are many and
    small, and rare shingles are the better keys (default: parts from 90 percent on).
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rare = (keys or ("parts" if percent >= 90 else "rare")) == "rare"
    signed = written(shingle_sets(base, k, percent, shingle_weights(base, k)) if rare else part_keys(base, k, percent), "jaccard-signed")
    sets = written(signed.filter("id is not null").groupBy("id").agg(F.min("doc_id").alias("low"), F.max("n").alias("n")), "jaccard-ids")
    roots = (_roots_by_rare_shingles if rare else _roots_by_parts)(base, signed, sets, k, percent)

    named = sets.join(roots, "id", "left").select("id", "low", F.coalesce("root", "id").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_set = named.join(lowest, "root").select("id", "component_id")
    return (signed.select("doc_id", "n", "id").join(by_set, "id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNull(), F.col("doc_id"))
                    .otherwise(F.coalesce("component_id", "doc_id")).alias("component_id")))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns: one document of each component stays, that of the smallest id.

    Documents without words or without an id all stay; of rows that repeat an
    id, one stays.
    """
    doc_id = options.get("doc_id", "doc_id")
    names = docs.columns
    found = written(components_by_jaccard(docs, **options), "jaccard-found")
    # Names that no column of the input bears.
    gone_id, twice_id = unused_name(names, "gone"), unused_name(names, "twice")
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(gone_id)).distinct()
    gone = written(gone, "jaccard-gone")
    left = docs.join(sized_broadcast(gone, gone.count(), 8, 64 << 20), F.col(doc_id) == F.col(gone_id), "left_anti")
    twice = written(found.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().filter("count > 1")
                    .select(F.col("doc_id").alias(twice_id)), "jaccard-twice")
    if not twice.take(1):
        return left.select(*names)
    again = left.join(twice, F.col(doc_id) == F.col(twice_id), "left_semi").dropDuplicates([doc_id])
    return left.join(twice, F.col(doc_id) == F.col(twice_id), "left_anti").select(*names).unionByName(again.select(*names))
