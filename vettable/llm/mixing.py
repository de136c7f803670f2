"""Operator 7: mixing sources to target weights by Pfair scheduling.

Each source's documents are put in a fixed pseudo-random order (hash of the id)
and cut into blocks of ``block_chars`` characters. With target weight ``q / cycle`` (an
exact fraction) the j-th block of a source has release time ``floor((j - 1) * cycle / q)``
and deadline ``ceil(j * cycle / q)`` (in blocks of output). One block goes out per
slot: earliest deadline first among the released blocks. ``cycle`` is the least
common denominator of the weights, so the schedule repeats after ``cycle`` slots; it
is worked out once for one cycle (at most ``MAX_CYCLE`` entries, on the driver) and
every block finds its slot by a join with that small table. Weights are never
rounded behind the user's back: after any number of slots, over any number of
cycles, each source has less than one block more or less than its weight asks
for, as long as no source has run out (column ``balanced``). Weights whose common
denominator is above ``MAX_CYCLE`` are refused; ``rounded_weights`` turns any
positive numbers into weights with a given denominator, and the sizes to the
power ``temper`` that stand in for absent weights are such weights (denominator
``RESOLUTION``, or four times the number of sources if that is more).

Blocks are counted in characters, and a document belongs to the block in which
it starts; documents are not split. So a source's characters after any number of
slots differ from its weight's by less than one block plus its longest document.

Documents never move through one task by source: running sizes are windows over
(source, hash bucket), with ``BUCKETS`` buckets per source, and the offsets of the
buckets are a second window over their totals. DataFrame operations only.

Results are whole: every input row gets a slot. When a source has run out its
slots stay empty and the others go on; sources without a weight come last (null
slot). Null sources are one source (weight key ``None``); null and empty texts
count as one character; a null ``doc_id`` is an id like others; repeated rows are
separate documents; an empty table gives no rows. Columns of ``docs`` stay;
columns with the names of the results are replaced.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_CHARS = 1 << 16
BUCKETS = 1024
RESOLUTION = 10_000
#: Most slots of a cycle: the driver's table holds one small row per slot.
MAX_CYCLE = 200_000
RESULTS = ("block", "release", "deadline", "slot", "balanced")


def exact_units(weights: dict[str, float | Fraction]) -> tuple[dict[str, int], int]:
    """(units per source, units in all) of the shares of ``weights``, without rounding.

    Floats count as the decimal numbers they print as (0.1 is one tenth). Weights
    of 0 or less are left out.
    """
    positive = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in weights.items() if w > 0}
    if not positive:
        return {}, 0
    total = sum(positive.values())
    shares = {s: w / total for s, w in positive.items()}
    cycle = math.lcm(*[x.denominator for x in shares.values()])
    if cycle > MAX_CYCLE:
        raise ValueError(f"the weights repeat only after {cycle} blocks, more than {MAX_CYCLE}; "
                         "give fractions with a smaller common denominator (see rounded_weights)")
    return {s: int(x * cycle) for s, x in shares.items()}, cycle


def rounded_weights(weights: dict[str, float], denominator: int = RESOLUTION) -> dict[str, Fraction]:
    """Shares of ``weights`` as multiples of ``1 / denominator`` that add up to 1.

    Largest remainders, at least one multiple for each positive weight (so the
    denominator is raised to four times the number of sources where it is less).
    """
    positive = {s: Fraction(w) for s, w in weights.items() if w > 0}
    if not positive:
        return {}
    denominator = max(denominator, 4 * len(positive))
    total = sum(positive.values())
    exact = {s: w / total * denominator for s, w in positive.items()}
    units = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    while (short := denominator - sum(units.values())) != 0:
        if short > 0:
            for s in order[:short]:
                units[s] += 1
        else:
            units[max(units, key=lambda s: (units[s] - exact[s] if units[s] > 1 else -1, s))] -= 1
    return {s: Fraction(u, denominator) for s, u in units.items()}


def one_cycle(units: dict[str, int], cycle: int) -> dict[str, list[int]]:
    """Slots of each source's blocks in one cycle: earliest deadline first among released blocks."""
    releases: dict[int, list[tuple[int, str, int]]] = {}
    for s, q in units.items():
        for j in range(1, q + 1):
            releases.setdefault((j - 1) * cycle // q, []).append((-(-j * cycle // q), s, j))
    slots: dict[str, list[int]] = {s: [0] * q for s, q in units.items()}
    ready: list[tuple[int, str, int]] = []
    for t in range(cycle):
        for job in releases.get(t, ()):
            heapq.heappush(ready, job)
        deadline, s, j = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("units do not add up to the cycle")
        slots[s][j - 1] = t
    return slots


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def schedule(docs: DataFrame, weights: dict[str | None, float | Fraction] | None = None, *,
             source: str = "source", text: str = "text", doc_id: str = "doc_id", block_chars: int = BLOCK_CHARS,
             temper: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus ``block, release, deadline, slot, balanced`` and the order key ``mix_key``.

    ``weights`` are target shares of the sources (any scale), taken exactly; sources
    without documents are left out. Without them a source weighs its
    size in characters to the power ``temper``, as ``rounded_weights``. ``keep`` names
    the columns of ``docs`` to return (default: all); others are not shuffled.
    """
    spark = docs.sparkSession
    names = [c for c in keep or docs.columns if c not in (*RESULTS, "mix_key")]
    rows = docs.select(
        F.struct(*names).alias("row"), _source_key(source).alias("s"),
        F.greatest(F.coalesce(F.length(F.col(text)), F.lit(0)), F.lit(1)).cast("long").alias("size"),
        F.xxhash64(F.lit("mix"), F.col(doc_id)).alias("h"), F.col(doc_id).alias("d"))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    totals = written(rows.groupBy("s", "bucket").agg(F.sum("size").alias("total")), "mix-totals")
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("s", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    # One row per source: as many as there are target weights.
    sizes = {r["s"]: r["n"] for r in totals.groupBy("s").agg(F.sum("total").alias("n")).collect()}
    if weights is None:
        wanted = rounded_weights({s: n ** temper for s, n in sizes.items()})
    else:
        wanted = {("null" if k is None else f"={k}"): w for k, w in weights.items()}
    units, cycle = exact_units({s: w for s, w in wanted.items() if s in sizes})
    table = one_cycle(units, cycle)
    slots = spark.createDataFrame([(s, j, units[s], t) for s, v in table.items() for j, t in enumerate(v)],
                                  "s string, turn long, units long, offset long")
    # The first slot that a source with no blocks left would have filled.
    n_blocks = {s: -(-sizes[s] // block_chars) for s in units}
    ends = [n_blocks[s] // units[s] * cycle + table[s][n_blocks[s] % units[s]] for s in units]
    limit = min(ends, default=0)

    inside = (Window.partitionBy("s", "bucket").orderBy("h", F.col("d").asc_nulls_first(), "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(base, ["s", "bucket"])
              .withColumn("block", F.expr(f"(at + base) div {block_chars}") + 1))
    unit = F.create_map(*[F.lit(x) for s, q in units.items() for x in (s, q)])[F.col("s")] if units else F.lit(None)
    placed = placed.withColumn("turn", F.pmod(F.col("block") - 1, unit.cast("long")))
    # At most MAX_CYCLE rows of a string and three numbers.
    out = placed.join(F.broadcast(slots), ["s", "turn"], "left")
    j, q = F.col("block"), F.col("units")
    return out.select(
        *[F.col("row")[n].alias(n) for n in names], "block",
        F.expr(f"((block - 1) * {cycle}L) div units").alias("release"),
        F.expr(f"(block * {cycle}L + units - 1) div units").alias("deadline"),
        (F.floor((j - 1) / q) * F.lit(cycle) + F.col("offset")).cast("long").alias("slot"),
        F.struct("bucket", "h", F.col("d").alias("d")).alias("mix_key"),
    ).withColumn("balanced", F.coalesce(F.col("slot") < F.lit(limit), F.lit(False)))


def in_mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None, **options) -> DataFrame:
    """``docs`` with its columns, its rows in the order of the schedule.

    The order is that of the written files: ranges of slots are dealt to
    ascending partitions and sorted inside them.
    """
    names = docs.columns
    s = schedule(docs, weights, **options)
    keys = [F.col("slot").asc_nulls_last(), F.col("mix_key").asc()]
    n = max(docs.sparkSession.sparkContext.defaultParallelism,
            int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return s.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(*names)
